"""Corpus files: JSON arrays, JSON lines, quote-free TSV, manifests, published ids.

Schemas are always explicit; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.text import ARABIC, TextProfile, text_id
from labelloom.operators.ranking import row_ids
from labelloom.sources.json_arrays import read_json_array, write_json_array  # noqa: F401

NO_NULL = "\u0000"  # a cell value that never occurs, so that empty cells stay empty


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Splittable form of the same corpus; the row number is a field of the record."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Tab separated without any quoting; all strings; empty cells are empty strings."""
    df = spark.read.csv(
        path, schema=string_schema(columns), sep="\t", header=True, quote="", escape="",
        emptyValue="", nullValue=NO_NULL, mode="FAILFAST", enforceSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return df.fillna("")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quote-free TSV; tabs and line ends inside cells become blanks."""
    flat = df.select(
        *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\n\r]", " ").alias(c) for c in df.columns]
    )
    flat.write.csv(
        path, mode=mode, sep="\t", header=True, quote="", escape="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


MANIFEST_DIALECT = {
    "sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True,
}


def write_manifest_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Manifest export with minimal quoting (the native store is Parquet)."""
    opts = {k: v for k, v in MANIFEST_DIALECT.items() if k != "multiLine"}
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.csv(
        path, mode=mode, emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, **opts,
    )


def read_manifest_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.csv(
        path, schema=string_schema(columns), emptyValue="", nullValue=NO_NULL, mode="FAILFAST",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **MANIFEST_DIALECT,
    ).fillna("")


def pool(sources: Sequence[tuple[str, DataFrame]], position: str = "row_no", id_name: str = "id") -> DataFrame:
    """Union of sources with ``src_file`` and a 1-based id in (source order, position) order."""
    parts = [
        df.withColumn("src_file", F.lit(PurePosixPath(name).name)).withColumn("_file", F.lit(i))
        for i, (name, df) in enumerate(sources)
    ]
    pooled = parts[0]
    for p in parts[1:]:
        pooled = pooled.unionByName(p)
    return row_ids(pooled, "_file", position, id_name).drop("_file")


def weak_label_table(
    labelled: DataFrame, row_no: str, text: str, source: str, category: str,
    label: str, conf: str, label_names: Sequence[str],
) -> DataFrame:
    """The published weak-label layout: 1-based id, cleaned text, confidence to 3 digits."""
    names = F.array(*[F.lit(n) for n in label_names])
    return labelled.select(
        (F.col(row_no) + 1).alias("id"),
        F.regexp_replace(F.col(text), "[\t\n]", " ").alias("text"),
        F.col(source).alias("source"),
        F.col(category).alias("keyword_cat"),
        F.col(label).alias("weak_label"),
        F.get(names, F.col(label)).alias("label_name"),
        F.bround(F.col(conf), 3).alias("confidence"),
        F.lit("").alias("human_label"),
    )


def weak_label_records(
    labelled: DataFrame, keep: Sequence[str], label_names: Sequence[str]
) -> DataFrame:
    """The JSON layout: the record's own fields plus both votes with names and confidences."""
    names = F.array(*[F.lit(n) for n in label_names])
    return labelled.select(
        *keep,
        F.col("mv_label").alias("weak_label_mv"),
        F.get(names, F.col("mv_label")).alias("weak_label_mv_name"),
        F.bround("mv_conf", 3).alias("weak_conf_mv"),
        F.col("wv_label").alias("weak_label_wv"),
        F.get(names, F.col("wv_label")).alias("weak_label_wv_name"),
        F.bround("wv_conf", 3).alias("weak_conf_wv"),
    )


def reattach(
    texts: DataFrame, text: str, published: DataFrame, profile: TextProfile = ARABIC
) -> tuple[DataFrame, DataFrame]:
    """Join published labels (one row per ``uid``) to privately held texts.

    Returns the matched rows and the published ids without a text.
    """
    with_id = texts.withColumn("uid", text_id(text, profile))
    matched = with_id.join(published, "uid", "inner")
    missing = published.join(with_id.select("uid").distinct(), "uid", "left_anti")
    return matched, missing


def published_ids(manifest: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Projection of a manifest without texts."""
    return manifest.select(*columns)
