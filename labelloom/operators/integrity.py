"""Leakage between partitions, uniqueness, content digests, freeze and firewall checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import bits
from labelloom.functions.arrays import argmax
from labelloom.functions.text import ARABIC, TextProfile, preprocess

# Names of the six representations.
STRICT_VIEWS = ("uid", "raw_sha256", "none", "minimal", "alg3")
REPORT_VIEWS = ("mhamed",)
VIEWS = STRICT_VIEWS + REPORT_VIEWS


# --------------------------------------------------------------------------------- leakage
def representation_keys(
    text: str, profile: TextProfile = ARABIC, stop_words: Iterable[str] = ()
) -> Column:
    """Array of (view, key): the two stored hashes and the hash of the text under each mode.

    Keys travel as 32 raw bytes, never as text."""
    stop = list(stop_words)
    modes = ("none", "minimal", "alg3", "mhamed")
    return F.array(
        F.struct(F.lit("uid").alias("view"), F.unhex("uid").alias("key")),
        F.struct(F.lit("raw_sha256").alias("view"), F.unhex("raw_sha256").alias("key")),
        *[
            F.struct(
                F.lit(m).alias("view"),
                F.unhex(F.sha2(preprocess(text, m, profile, stop), 256)).alias("key"),
            )
            for m in modes
        ],
    )


def leakage_matrix(
    df: DataFrame,
    keys: Column,
    part: str,
    parts: Sequence[str] = ("train", "val", "test"),
    views: Sequence[str] = VIEWS,
) -> DataFrame:
    """Keys shared by each pair of partitions under each view; zero rows are listed too.

    One aggregation serves all pairs and views: every key ends up with the set of the
    partitions it was seen in, so a boiler-plate key is one small record per map task.  There may be any number of
    partitions; rows of others count nowhere.
    """
    size, names = len(parts), bits.names("_m", len(parts))
    masked = df.select(
        *[w.alias(n) for w, n in zip(bits.words(bits.place(F.col(part), parts), size), names, strict=True)], F.inline_outer(keys))
    counts = _pair_counts(masked, names, bits.members("_m", size), size, views)
    return counts.select("view", _pair_name("i", "j", parts).alias("pair"), "n_shared")


def _pair_name(i: str, j: str, parts: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(p) for p in parts])
    return F.concat(F.get(listed, F.col(i)), F.lit("&"), F.get(listed, F.col(j)))


def _pair_counts(masked: DataFrame, names: list[str], members: Column, size: int, views: Sequence[str],
                 group: int | None = None) -> DataFrame:
    """``(view, i, j, n_shared)``: keys whose set holds both numbers, for all pairs (of one group) and views."""
    sets = masked.groupBy("view", "key").agg(*[F.bit_or(n).alias(n) for n in names])
    sets = sets.groupBy("view", *names).agg(F.count(F.lit(1)).alias("n")).select("view", "n", members.alias("_held"))
    found = sets.select("view", "n", F.inline(bits.pairs(F.col("_held"), group)))
    # A pair that shares nothing must still show its zero.
    every = F.sequence(F.lit(0), F.lit(size - 1))
    zeros = masked.sparkSession.range(1).select(every.alias("_all"), F.explode(F.array(*[F.lit(v) for v in views])).alias("view"))
    zeros = zeros.select("view", F.lit(0).cast("long").alias("n"), F.inline(bits.pairs(F.col("_all"), group)))
    return found.unionByName(zeros).groupBy("view", "i", "j").agg(F.sum("n").alias("n_shared"))


def with_severity(matrix: DataFrame, fatal_all: bool = False) -> DataFrame:
    """Mark the counts that must be zero; the lossy view is only reported unless ``fatal_all``."""
    fatal = F.lit(True) if fatal_all else ~F.col("view").isin(*REPORT_VIEWS)
    return matrix.select("*", fatal.alias("fatal"), (fatal & (F.col("n_shared") > 0)).alias("leak"))


def assert_no_leakage(matrix: DataFrame, fatal_all: bool = False) -> None:
    """Action: raise when a fatal count is not zero (at most views x pairs rows reach the driver)."""
    bad = with_severity(matrix, fatal_all).filter("leak").collect()
    if bad:
        raise AssertionError("leakage: " + ", ".join(f"{r.n_shared} {r.view} keys in {r.pair}" for r in bad))


def leakage_by_fold(
    df: DataFrame,
    keys: Column,
    folds: str,
    k: int,
    parts: Sequence[str] = ("train", "val", "test"),
    views: Sequence[str] = VIEWS,
) -> DataFrame:
    """The same counts in every fold, still with one aggregation over one row per text.

    ``folds`` is the array of roles (one entry per fold).  The roles of all folds are one set, ``len(parts)`` numbers
    per fold, instead of repeating each row k times.
    """
    width = len(parts)
    size, names = k * width, bits.names("_m", k * width)
    columns = [F.lit(0).cast("long")] * len(names)
    for f in range(k):
        role = bits.place(F.get(F.col(folds), F.lit(f)), parts)
        own = bits.words(F.when(role >= 0, role + f * width).otherwise(-1), size)
        for w in range(f * width // bits.WIDTH, ((f + 1) * width - 1) // bits.WIDTH + 1):
            columns[w] = columns[w].bitwiseOR(own[w])
    masked = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], F.inline_outer(keys))
    counts = _pair_counts(masked, names, bits.members("_m", size), size, views, group=width)
    at = counts.select("view", F.floor(F.col("i") / width).cast("int").alias("fold"), (F.col("i") % width).alias("i"),
                       (F.col("j") % width).alias("j"), "n_shared")
    return at.select("fold", "view", _pair_name("i", "j", parts).alias("pair"), "n_shared")


def repeated_keys(df: DataFrame, key: str = "uid") -> DataFrame:
    """Rows, distinct keys, and keys that occur more than once (0 is the assertion)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
    )


# --------------------------------------------------------------------------------- digests
def framed(columns: Sequence[str]) -> Column:
    """The row's values as one text: each behind its length, nulls marked, so that no value can
    be mistaken for a border between two."""
    def part(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("n"))

    return F.concat_ws(",", *[part(c) for c in columns])


def row_fingerprint(columns: Sequence[str]) -> Column:
    """md5 of the framed row."""
    return F.md5(framed(columns))


def content_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive digest per table (or per ``by`` group): row count, sum and xor of 60-bit
    fingerprints.  The sum catches what xor cancels (a row stored twice)."""
    fp = F.conv(F.substring(row_fingerprint(columns), 1, 15), 16, 10).cast("long")
    return (
        df.select(*by, fp.alias("_fp"))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(F.col("_fp").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fp_sum"),
            F.coalesce(F.bit_xor("_fp"), F.lit(0).cast("long")).alias("fp_xor"),
        )
    )


def digest_changes(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Artefacts whose digest is missing or differs afterwards."""
    a = before.select(*by, F.concat_ws(":", "n_rows", "fp_sum", "fp_xor").alias("digest_before"))
    b = after.select(*by, F.concat_ws(":", "n_rows", "fp_sum", "fp_xor").alias("digest_after"))
    return a.join(b, list(by), "left").filter(
        ~F.col("digest_before").eqNullSafe(F.col("digest_after"))
    )


def input_hash(digests: DataFrame, group: Sequence[str], run: Sequence[str]) -> DataFrame:
    """One SHA-256 per group over the sorted digests of its runs (a handful per group)."""
    line = F.concat_ws(":", *run, "n_rows", "fp_sum", "fp_xor")
    return digests.groupBy(*group).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("inputs_sha256"),
        F.count(F.lit(1)).alias("n_inputs"),
    )


# ------------------------------------------------------------------------ freeze, firewall
def freeze_check(frozen: DataFrame, now: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Compare frozen selections ``(name, digest)`` with the present ones.

    ``status``: ok, changed, missing (frozen but gone) or unfrozen (expected, never frozen).
    """
    names = frozen.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(e) for e in expected])).alias("name")
    )
    f = frozen.select("name", F.col("digest").alias("frozen_digest"))
    n = now.select("name", F.col("digest").alias("digest"))
    joined = names.join(f, "name", "full").join(n, "name", "left")
    return joined.select(
        "name",
        F.when(F.col("frozen_digest").isNull(), "unfrozen")
        .when(F.col("digest").isNull(), "missing")
        .when(F.col("digest") != F.col("frozen_digest"), "changed")
        .otherwise("ok")
        .alias("status"),
    )


def assert_frozen(frozen: DataFrame, now: DataFrame, expected: Sequence[str]) -> None:
    """Action, called before any test row is opened: raise unless every expected selection is
    frozen and unchanged (one row per selection reaches the driver)."""
    bad = freeze_check(frozen, now, expected).filter("status <> 'ok'").orderBy("name").collect()
    if bad:
        raise RuntimeError("test data stays closed, selections not as frozen: " + ", ".join(f"{r.name}={r.status}" for r in bad))


def firewall_check(
    selections: DataFrame, predictions: DataFrame, candidate: str, split: str, ts: str
) -> DataFrame:
    """Per selection: test rows of its candidates and how many are not later than the freeze.

    ``selections``: (name, candidate, frozen_at).  Predictions are first reduced to one row per
    candidate (first test time and per-time counts are algebraic), then joined.
    """
    test = predictions.filter(F.col(split) == "test").groupBy(candidate, ts).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = selections.join(test, candidate, "left")
    late = F.col(ts) > F.col("frozen_at")
    return joined.groupBy("name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_test_rows"),
        F.coalesce(F.sum(F.when(~late, F.col("n"))), F.lit(0)).alias("n_before_freeze"),
        F.coalesce(F.min(ts) > F.max("frozen_at"), F.lit(True)).alias("ok"),
    )


def reproduction_check(
    a: DataFrame, b: DataFrame, key: Sequence[str], scores: str, by: Sequence[str] = (),
    min_agreement: float = 0.99,
) -> DataFrame:
    """Two prediction sets of the same keys: share of equal argmax, largest score difference,
    keys found on one side only."""
    x = a.select(*key, *[c for c in by if c not in key], F.col(scores).alias("_a"))
    y = b.select(*key, F.col(scores).alias("_b"))
    gap = F.aggregate(
        F.zip_with("_a", "_b", lambda p, q: F.abs(p.cast("double") - q.cast("double"))),
        F.lit(0.0), lambda acc, d: F.greatest(acc, d),
    )
    joined = x.join(y, list(key), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    agree = F.avg(F.when(both, (argmax("_a") == argmax("_b")).cast("double")))
    return joined.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.count_if(~both).alias("n_unmatched"),
        agree.alias("argmax_agreement"),
        F.max(F.when(both, gap)).alias("max_abs_diff"),
    ).withColumn(
        "ok",
        (F.col("n_unmatched") == 0)
        & F.coalesce(F.col("argmax_agreement") >= min_agreement, F.lit(False)),
    )


def alignment_check(
    predictions: DataFrame, members: Sequence[str], system: str, run: Sequence[str],
    uid: str, y: str, n_classes: int,
) -> DataFrame:
    """Members of an ensemble must cover the same keys with the same truth and width.

    One row per run: keys, keys not covered exactly once by every member, keys with
    conflicting truth, keys whose score arrays have another length.
    """
    size, seen = len(members), bits.names("_seen", len(members))
    per_key = (
        predictions.filter(F.col(system).isin(*members))
        .groupBy(*run, uid)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.bit_or(w).alias(n) for w, n in zip(bits.words(bits.place(F.col(system), members), size), seen, strict=True)],
            F.min(y).alias("lo"),
            F.max(y).alias("hi"),
            F.max((F.size("probs") != n_classes).cast("int")).alias("bad"),
        )
    )
    everyone = F.lit(True)
    for w, n in enumerate(seen):
        everyone = everyone & (F.col(n) == (1 << min(bits.WIDTH, size - w * bits.WIDTH)) - 1)
    return per_key.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if((F.col("n") != size) | ~everyone).alias("misaligned"),
        F.count_if(F.col("lo") != F.col("hi")).alias("label_mismatch"),
        F.count_if(F.col("bad") == 1).alias("wrong_width"),
    )
