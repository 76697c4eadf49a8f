"""From a raw corpus to frozen, de-duplicated, split and relabelled manifests.

Order matters: de-duplicate on the stored labels, split on the stored labels, fit the rule
weights on the training part of the *kept* rows, relabel all rows with those weights.

Texts are read for exactly three things: votes, keys (both written as thin tables) and the
final manifest.  Everything between works on ids, hashes and labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.functions.text import ARABIC, TextProfile, preprocess
from labelloom.operators import consensus, dedup, integrity, splits, weak
from labelloom.operators.lexicon import Lexicons
from labelloom.operators.ranking import range_rank
from labelloom.operators.rules import LABEL_NAMES, NEUTRAL, RULES, Rule, apply_rules

# Coarse label of every fine label.
BINARY = {"HATE": "HARMFUL", "OFFENSIVE": "HARMFUL"}
BINARY_OTHER = "NEUTRAL"


@dataclass(frozen=True)
class CorpusPlan:
    """Columns of the annotated corpus and the choices of the build."""

    lexicons: Lexicons
    rules: Sequence[Rule] = RULES
    labels: Sequence[str] = tuple(LABEL_NAMES)
    default_label: int = NEUTRAL
    binary: dict = field(default_factory=lambda: dict(BINARY))
    binary_other: str = BINARY_OTHER
    row_id: str = "id"
    text: str = "text"
    weak_label: str = "ws_label"
    annotators: tuple[str, str] = ("gpt_label", "llama_label")
    tie_breaker: str = "gpt_label"
    final_label: str = "final_label"
    method: str = "method"
    extra: Sequence[str] = ("source", "keyword_cat")
    seed: int = 42
    held_out: float = 0.2
    test_share: float = 0.5
    weights_from_train: bool = True
    profile: TextProfile = ARABIC
    stop_words: Sequence[str] = ()


def freeze_corpus(corpus: DataFrame, plan: CorpusPlan) -> dict[str, DataFrame]:
    """Tables ``manifest``, ``flips``, ``dedup``, ``weights_train``, ``weights_full``, ``drift``.

    Runs two staging jobs (votes, keys); the rest is lazy.
    """
    p = plan
    rid = p.row_id
    m = [r.name for r in p.rules]
    votes = stage(apply_rules(corpus, p.text, p.lexicons, p.rules, [rid]), "votes")
    keys = stage(
        dedup.text_keys(corpus, p.text, [rid, F.col(p.final_label).alias("label3_v1")], p.profile),
        "keys",
    )
    kept = dedup.kept_rows(keys, "label3_v1", rid, p.labels)
    thin = stage(
        kept.join(keys.select(F.col(rid).cast("long").alias(rid), "label3_v1", "raw_sha256"), rid),
        "kept",
    )
    split = splits.stratified_split(
        thin, "uid", "label3_v1", list(p.labels), p.seed, p.held_out, p.test_share
    )
    kept_votes = stage(
        thin.join(split.select("uid", "split"), "uid").join(
            votes.withColumn(rid, F.col(rid).cast("long")), rid
        ),
        "kept-votes",
    )
    train_votes = kept_votes.filter(F.col("split") == "train")
    fit_rows = train_votes if p.weights_from_train else votes
    voted = weak.weighted_vote(
        kept_votes, weak.weight_array(fit_rows, len(m)), len(p.labels), p.default_label, "ws"
    )
    names = F.array(*[F.lit(n) for n in p.labels])
    relabelled = voted.select(
        rid, "uid", "split", "label3_v1", "raw_sha256",
        F.get(names, F.col("ws_label")).alias("ws_v2"),
        F.bround(F.col("ws_conf") if p.weights_from_train else F.lit(0.0), 4).alias("ws_v2_conf"),
        F.col("ws_novote"),
    )
    # Position of every row in the raw corpus, counted over all rows, kept or not.
    rows = range_rank(corpus.select(F.col(rid).cast("long").alias(rid)), [], [F.col(rid).asc()], name="orig_row")
    relabelled = relabelled.join(rows.withColumn("orig_row", F.col("orig_row") - 1), rid)
    stored = corpus.select(
        F.col(rid).cast("long").alias(rid), F.col(p.weak_label).alias("ws_v1"), *p.annotators,
        F.col(p.method).alias("method_v1"), *p.extra, F.col(p.text).alias("text"),
    )
    label, method = consensus.resolve(("ws_v2", *p.annotators), p.tie_breaker)
    joined = relabelled.join(stored, rid).select("*", label.alias("label3"), method.alias("method_v2"))
    manifest = joined.select(
        "uid", F.col(rid).alias("orig_id"), "orig_row", "split", "label3",
        consensus.coarsen("label3", p.binary, p.binary_other).alias("label_bin"),
        "label3_v1",
        consensus.coarsen("label3_v1", p.binary, p.binary_other).alias("labelb_v1"),
        "ws_v2", "ws_v2_conf", "ws_novote", "ws_v1", *p.annotators, "method_v2", "method_v1",
        *p.extra, "raw_sha256", "text",
    )
    weights_train = weak.rule_weights(train_votes, m)
    weights_full = weak.rule_weights(votes, m)
    return {
        "manifest": manifest,
        "dedup": dedup.dedup_report(keys, "label3_v1", p.labels),
        "flips": weak.label_flips(
            manifest, "split",
            {
                "ws_label_changed": ("ws_v1", "ws_v2"),
                "final3_changed": ("label3_v1", "label3"),
                "binary_changed": ("labelb_v1", "label_bin"),
            },
        ),
        "weights_train": weights_train,
        "weights_full": weights_full,
        "drift": weak.weight_drift(weights_train, weights_full),
    }


def write_frozen(tables: dict[str, DataFrame], path: str, plan: CorpusPlan) -> DataFrame:
    """Write the manifest (one folder per split), prove disjointness on what was written and
    return it.  An existing manifest stops the job."""
    spark = tables["manifest"].sparkSession
    tables["manifest"].write.mode("errorifexists").partitionBy("split").parquet(f"{path}/manifest")
    written = spark.read.parquet(f"{path}/manifest")
    matrix = integrity.leakage_matrix(
        written, integrity.representation_keys("text", plan.profile, plan.stop_words), "split"
    )
    integrity.assert_no_leakage(stage(matrix, "leakage"))
    return written


def freeze_auxiliary(
    pooled: DataFrame, main: DataFrame, labels: Sequence[str], seed: int = 42,
    profile: TextProfile = ARABIC, test_frac: float = 0.2, val_frac_of_train: float = 0.1,
) -> DataFrame:
    """Second corpus: de-duplicated, split, and flagged where it meets the main corpus."""
    keys = stage(dedup.text_keys(pooled, "text", ["id", "label"], profile), "aux-keys")
    kept = stage(
        dedup.kept_rows(keys, "label", "id", labels).join(
            keys.select(F.col("id").cast("long").alias("id"), "label", "raw_sha256"), "id"
        ),
        "aux-kept",
    )
    split = splits.nested_split(kept, "uid", "label", list(labels), seed, test_frac, val_frac_of_train)
    flagged = dedup.collision_flags(
        kept.join(split.select("uid", "split"), "uid"), main, F.col("split").isin("val", "test")
    )
    texts = pooled.select(F.col("id").cast("long").alias("id"), "src_file", "text")
    return flagged.join(texts, "id").select(
        "uid", F.col("id").alias("pool_id"), "split", "label", "src_file",
        F.col("collides_any").alias("collides_hs_any"), F.col("exclude").alias("mtl_exclude"),
        "raw_sha256", "text",
    )


def freeze_folds(
    pooled: DataFrame, labels: Sequence[str], seed: int = 42, k: int = 10,
    val_frac: float = 1.0 / 9.0, profile: TextProfile = ARABIC, group: str | None = None,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Fold corpus: de-duplicated, ``fold`` where a row is tested, ``parts`` its role per fold.

    ``group`` = "mhamed" keeps rows with the same bag-of-words input in one part.
    """
    keys = dedup.text_keys(
        pooled, "text",
        ["id", "label", F.sha2(preprocess("text", group or "none", profile, stop_words), 256).alias("gid")],
        profile,
    )
    keys = stage(keys, "fold-keys")
    kept = stage(
        dedup.kept_rows(keys, "label", "id", labels).join(
            keys.select(F.col("id").cast("long").alias("id"), "label", "raw_sha256", "gid"), "id"
        ),
        "fold-kept",
    )
    folds = (
        splits.stratified_group_kfold(kept, "uid", "gid", "label", list(labels), seed, k, val_frac)
        if group
        else splits.stratified_kfold(kept, "uid", "label", list(labels), seed, k, val_frac)
    )
    texts = pooled.select(F.col("id").cast("long").alias("id"), "src_file", "text")
    return (
        folds.select("uid", "fold", "parts").join(kept, "uid").join(texts, "id")
        .select("uid", F.col("id").alias("pool_id"), "fold", "label", "src_file", "raw_sha256", "parts", "text")
    )
