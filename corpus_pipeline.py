"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it to the shared folder and
hands the written table to the next stage.  All but the last stage return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.staging import fresh_path, stage
from labelloom.llm import contamination, jaccard_join, mixing, quality, token_files

#: SQL cannot express a trained classifier, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier gives 0.7 or more."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.7)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, also not with other numbers, names or units."""
    return contamination.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.drawn(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document, read back from the token files."""
    import public_tokenizers

    path = fresh_path(spark, "pipeline-tokens")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digest(spark, path)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return docs
