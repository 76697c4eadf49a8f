"""De-duplication by canonical key, with a label-conflict policy, and cross-corpus collisions.

The aggregates carry fixed-size values only (counts, row ids, label codes), so Spark uses hash
aggregation with map-side combine: a key that holds a third of all rows shrinks to one record
per task before the shuffle.  Texts are never aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import label_index
from labelloom.functions.text import ARABIC, TextProfile, canonical_key, known, raw_hash


def text_keys(
    df: DataFrame, text: str, keep: Sequence[str | Column], profile: TextProfile = ARABIC
) -> DataFrame:
    """Thin table: ``keep`` columns, ``uid``, ``raw_sha256`` and whether the key is empty."""
    keyed = df.select(*keep, F.col(text).alias("_text"), canonical_key(text, profile).alias("_key"))
    kept = [c for c in keyed.columns if c not in ("_text", "_key")]
    return keyed.select(
        *kept,
        known(F.sha2("_key", 256)).alias("uid"),
        raw_hash("_text").alias("raw_sha256"),
        (F.col("_key") == "").alias("is_empty"),
    )


def _label_code(label: str, labels: Sequence[str] | None) -> Column:
    """A fixed-size stand-in for the label.  With a declared label list it is the position in
    the list; without one the label itself is compared."""
    return label_index(label, list(labels)) if labels else F.col(label)


def canonical_groups(
    keys: DataFrame, label: str, row_id: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """One row per non-empty canonical key: size, smallest row id, whether labels conflict."""
    code = _label_code(label, labels)
    return (
        keys.select("uid", "is_empty", F.col(row_id).cast("long").alias("_id"), code.alias("_code"))
        .groupBy("uid")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("_id").alias(row_id),
            F.min("_code").alias("_lo"),
            F.max("_code").alias("_hi"),
            F.max("is_empty").alias("_empty"),
        )
        # Dropped after the aggregation: a filter on the key would normalise every text twice.
        .filter(~F.col("_empty"))
        .select("uid", "n_rows", row_id, (F.col("_lo") != F.col("_hi")).alias("conflict"))
    )


def kept_rows(
    keys: DataFrame, label: str, row_id: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """``(uid, row id)`` of the row that survives per key.

    Rows with an empty key go; a key with more than one label goes with all its rows; of the
    rest the row with the smallest numeric id stays.
    """
    groups = canonical_groups(keys, label, row_id, labels)
    return groups.filter(~F.col("conflict")).select("uid", row_id)


def deduplicate(
    df: DataFrame,
    text: str,
    label: str,
    row_id: str,
    labels: Sequence[str] | None = None,
    profile: TextProfile = ARABIC,
) -> DataFrame:
    """The surviving rows of ``df`` with ``uid``.

    The keys are worked out on a thin table; the rows are fetched back by row id (unique).
    A caller that needs only ids and labels pays for no text shuffle: Catalyst prunes it.
    """
    keep = kept_rows(text_keys(df, text, [row_id, label], profile), label, row_id, labels)
    return df.withColumn(row_id, F.col(row_id).cast("long")).join(keep, row_id)


def dedup_report(
    keys: DataFrame, label: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Twelve counters about raw and canonical duplicates, from one aggregation.

    Each row is counted under its raw hash and, unless empty, under its canonical key.
    """
    code = _label_code(label, labels)
    views = F.array(
        F.struct(F.lit("raw").alias("view"), F.col("raw_sha256").alias("key")),
        F.struct(
            F.when(F.col("is_empty"), "empty").otherwise("canonical").alias("view"),
            F.when(~F.col("is_empty"), F.col("uid")).otherwise("").alias("key"),
        ),
    )
    groups = (
        keys.select(code.alias("_code"), F.inline(views))
        .groupBy("view", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_code").alias("lo"),
            F.max("_code").alias("hi"),
        )
    )
    raw, canon = F.col("view") == "raw", F.col("view") == "canonical"
    mixed, n = F.col("lo") != F.col("hi"), F.col("n")

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    counted = groups.agg(
        rows(raw).alias("rows_in"),
        rows(F.col("view") == "empty").alias("empty_after_canonicalisation"),
        (rows(raw) - F.count_if(raw)).alias("exact_raw_duplicate_rows_beyond_first"),
        F.count_if(raw & (n > 1)).alias("exact_raw_duplicate_groups"),
        F.count_if(raw & mixed).alias("exact_raw_groups_with_label_conflict"),
        F.count_if(canon).alias("canonical_groups"),
        F.count_if(canon & (n > 1)).alias("canonical_groups_size_gt1"),
        rows(canon & (n > 1)).alias("rows_in_canonical_groups_size_gt1"),
        F.count_if(canon & mixed).alias("canonical_groups_with_label_conflict"),
        rows(canon & mixed).alias("rows_in_conflicting_groups"),
        F.count_if(canon & ~mixed).alias("rows_out"),
    )
    return counted.withColumn("rows_removed_total", F.col("rows_in") - F.col("rows_out"))


def collision_flags(
    df: DataFrame, other: DataFrame, held_out: Column, uid: str = "uid"
) -> DataFrame:
    """Flag rows whose key occurs in another corpus at all, or in its held-out partitions.

    The other corpus is first reduced to one record per key, so the join cannot multiply
    rows; Spark broadcasts it only when its measured size allows.
    """
    seen = other.groupBy(uid).agg(F.max(held_out.cast("int")).alias("_held"))
    return (
        df.join(seen.withColumn("_seen", F.lit(1)), uid, "left")
        .withColumn("collides_any", F.coalesce("_seen", F.lit(0)))
        .withColumn("exclude", F.coalesce("_held", F.lit(0)))
        .drop("_seen", "_held")
    )


def drop_excluded(flagged: DataFrame, split: str = "split") -> DataFrame:
    """Auxiliary training rows without those that collide with the other corpus' held-out part."""
    return flagged.filter((F.col(split) == "train") & (F.col("exclude") == 0))


def overlap_count(a: DataFrame, b: DataFrame, uid: str = "uid") -> DataFrame:
    """Number of distinct keys present in both tables (0 is the assertion)."""
    both = a.select(uid, F.lit(1).alias("s")).unionByName(b.select(uid, F.lit(2).alias("s")))
    return both.groupBy(uid).agg(F.bit_or("s").alias("s")).agg(
        F.count_if(F.col("s") == 3).alias("n_shared")
    )


def lossy_groups(
    df: DataFrame, group: Column, label: str, empty: Column, labels: Sequence[str] | None = None
) -> DataFrame:
    """Statistics of the groups of rows that share a lossy representation."""
    code = _label_code(label, labels)
    groups = (
        df.select(group.alias("_g"), code.alias("_l"), empty.cast("long").alias("_e"))
        .groupBy("_g")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("_l").alias("lo"), F.max("_l").alias("hi"),
            F.sum("_e").alias("e"),
        )
    )
    n = F.col("n")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(n > 1).alias("groups_size_gt1"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_groups_size_gt1"),
        F.max(n).alias("largest_group"),
        F.count_if(F.col("lo") != F.col("hi")).alias("groups_with_mixed_labels"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("rows_with_empty_input"),
    )
