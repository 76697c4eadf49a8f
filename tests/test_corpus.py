"""De-duplication, splits, folds, leakage: micro tables, skew, partition-count invariance."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.functions.text import ANY_SCRIPT
from labelloom.operators import consensus, dedup, integrity, splits
from labelloom.operators.ranking import dealt_in_order, exact_rank, first_k, hash_rank, range_rank


def test_consensus_rules(spark):
    rows = [("A", "A", "A"), ("A", "A", "B"), ("B", "A", "A"), ("A", "B", "A"), ("A", "B", "C")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, w string, g string, l string")
    got = consensus.consensus(df, ("w", "g", "l"), "g").orderBy("i").collect()
    assert [r.final_label for r in got] == ["A", "A", "A", "A", "B"]
    assert [r.method for r in got] == ["full_agreement"] + ["majority_vote"] * 3 + ["gpt_tiebreaker"]


def test_table_checks_count_missing_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "q")], "id int, t string")
    got = {r.check: (r.n, r.n_ok, r.ok) for r in consensus.table_checks(
        {"a": a, "b": b}, "id",
        {"same": F.col("a_t") == F.col("b_t"), "seen": F.col("b_t").isNotNull()}, ["seen"]).collect()}
    assert got == {"same": (3, 1, False), "seen": (3, 2, True)}


ROWS = [
    (10, "Hello World", "pos"), (9, "hello   world!", "pos"),    # same key: id 9 stays (numeric order)
    (2, "good day", "pos"), (3, "Good day", "neg"),               # conflict: the group goes
    (4, "!!!", "neg"), (5, "12", "pos"),                          # empty keys go
    (6, "alone", "neg"), (7, "alone", "neg"), (8, "alone", "neg"),
]


def test_dedup_policy_and_report(spark):
    df = spark.createDataFrame([(str(i), t, l) for i, t, l in ROWS], "id string, text string, label string")
    kept = dedup.deduplicate(df, "text", "label", "id", ["neg", "pos"], ANY_SCRIPT)
    assert sorted(r.id for r in kept.collect()) == [6, 9]
    keys = dedup.text_keys(df, "text", ["id", "label"], ANY_SCRIPT)
    for labels in (["neg", "pos"], None):
        r = dedup.dedup_report(keys, "label", labels).collect()[0].asDict()
        assert r == {
            "rows_in": 9, "empty_after_canonicalisation": 2, "exact_raw_duplicate_rows_beyond_first": 2,
            "exact_raw_duplicate_groups": 1, "exact_raw_groups_with_label_conflict": 0,
            "canonical_groups": 3, "canonical_groups_size_gt1": 3, "rows_in_canonical_groups_size_gt1": 7,
            "canonical_groups_with_label_conflict": 1, "rows_in_conflicting_groups": 2, "rows_out": 2,
            "rows_removed_total": 7,
        }


def test_unknown_label_stops_the_job(spark):
    df = spark.createDataFrame([(1, "a", "odd")], "id int, text string, label string")
    with pytest.raises(Exception, match="outside the declared list"):
        dedup.deduplicate(df, "text", "label", "id", ["neg", "pos"], ANY_SCRIPT).collect()


def test_a_third_of_all_rows_under_one_key(spark):
    n = 30_000
    spelled = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    own = F.regexp_replace(spelled, "(.)", "$1z")  # no runs that would shrink
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "same words").otherwise(own).alias("text"), F.lit("pos").alias("label")
    )
    kept = dedup.deduplicate(df, "text", "label", "id", ["pos"], ANY_SCRIPT)
    assert kept.count() == n - n // 3 + 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def ranked_rows(spark, n=500):
    rng = random.Random(1)
    return spark.createDataFrame(
        [(i, rng.choice(["a", "b", None]), rng.randint(0, 40)) for i in range(n)], "k int, g string, v int"
    )


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_exact_rank_equals_row_number_and_ignores_partitioning(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = ranked_rows(spark).repartition(parts)
        got = exact_rank(df, ["g"], [F.floor(F.col("v") / 10), F.floor(F.col("v") / 3)], [F.col("v"), F.col("k")]).collect()
        want = {}
        for g in ("a", "b", None):
            rows = sorted((r.v // 10, r.v // 3, r.v, r.k) for r in got if r.g == g)
            want.update({r[3]: i + 1 for i, r in enumerate(rows)})
        assert {r.k: r["rank"] for r in got} == want and len(got) == 500
        h = hash_rank(df.select("k").distinct(), [], "k", 42).collect()
        assert sorted(r["rank"] for r in h) == list(range(1, 501))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_first_k(spark):
    got = first_k(ranked_rows(spark), ["g"], [F.desc("v"), F.col("k")], 2).collect()
    assert len(got) == 6


def labelled(spark, sizes):
    rows, k = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((f"u{k}", label))
            k += 1
    return spark.createDataFrame(rows, "uid string, label string")


def counts(df, *cols):
    return {tuple(r[c] for c in cols): r["count"] for r in df.groupBy(*cols).count().collect()}


def test_split_sizes_follow_the_contract(spark):
    sizes = {"x": 101, "y": 53, "z": 7}
    df = labelled(spark, sizes)
    out = splits.stratified_split(df, "uid", "label", ["x", "y", "z"], 42)
    total = counts(out, "split")
    n, held = 161, math.ceil(0.2 * 161)
    assert total[("test",)] == math.ceil(0.5 * held) and total[("val",)] == held - math.ceil(0.5 * held)
    assert total[("train",)] == n - held
    per = counts(out, "split", "label")
    for label, size in sizes.items():
        assert abs(per[("train", label)] - size * (n - held) / n) < 1
    nested = counts(splits.nested_split(df, "uid", "label", ["x", "y", "z"], 42), "split")
    assert nested == {("test",): 33, ("val",): 13, ("train",): 115}


def test_absent_class_is_no_problem(spark):
    out = splits.stratified_split(labelled(spark, {"x": 20}), "uid", "label", ["w", "x"], 1)
    assert counts(out, "split") == {("train",): 16, ("val",): 2, ("test",): 2}


@pytest.mark.parametrize("parts", [1, 7])
def test_split_membership_ignores_partitioning(spark, parts):
    df = labelled(spark, {"x": 60, "y": 31})
    a = splits.stratified_split(df, "uid", "label", ["x", "y"], 42).orderBy("uid").collect()
    b = splits.stratified_split(df.repartition(parts), "uid", "label", ["x", "y"], 42).orderBy("uid").collect()
    assert a == b


def test_kfold_contract(spark):
    df = labelled(spark, {"x": 67, "y": 34, "z": 11})
    folds = splits.stratified_kfold(df, "uid", "label", ["x", "y", "z"], 42)
    check = splits.fold_partition_check(folds, "uid", 10).collect()[0].asDict()
    assert check == {"n_keys": 112, "never_tested": 0, "tested_twice": 0, "repeated_keys": 0, "wrong_length": 0}
    long = splits.fold_membership(folds, "uid")
    per = counts(long, "fold", "part")
    for f in range(10):
        test = per[(f, "test")]
        assert test in (11, 12) and per[(f, "val")] == math.ceil((112 - test) / 9)
        assert test + per[(f, "val")] + per[(f, "train")] == 112
    val_sets = {f: frozenset(r.uid for r in long.filter(f"part = 'val' and fold = {f}").collect()) for f in (0, 5)}
    assert val_sets[0] != val_sets[5]


def test_group_kfold_never_straddles(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", f"g{rng.randint(0, 30) if rng.random() < 0.5 else 100 + i}", rng.choice("xy")) for i in range(400)]
    rows += [(f"h{i}", "hot", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "uid string, g string, label string")
    folds = splits.stratified_group_kfold(df, "uid", "g", "label", ["x", "y"], 42).collect()
    assert len(folds) == 600
    per_group = {}
    for r in folds:
        per_group.setdefault(r.g, set()).add(tuple(r.parts))
        assert r.parts[r.fold] == "test" and list(r.parts).count("test") == 1
    assert all(len(v) == 1 for v in per_group.values())


def test_hot_group_is_split_by_the_join(spark):
    """A group with a third of all rows: the join back to the rows splits its partition."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("-1", "30KB", "20KB", "100")):
            spark.conf.set(n, v)
        df = spark.range(60_000).select(
            F.col("id").alias("uid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("g"),
            F.when(F.col("id") % 5 < 2, "x").otherwise("y").alias("label"),
        )
        folds = splits.stratified_group_kfold(df, "uid", "g", "label", ["x", "y"], 42)
        assert len(folds.collect()) == 60_000
        assert "skew=true" in folds._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_stratified_sample_is_blind_and_capped_by_class_size(spark):
    df = labelled(spark, {"x": 50, "y": 3})
    got = splits.stratified_sample(df, "uid", "label", ["x", "y"], 20, 42)
    assert counts(got, "label") == {("x",): 10, ("y",): 3}


# ------------------------------------------------------------------------------- integrity
def parted(spark, rows):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "id int, text string, part string")
    return dedup.text_keys(df, "text", ["id", "text", "part"], ANY_SCRIPT)


def matrix(df, stop=()):
    keys = integrity.representation_keys("text", ANY_SCRIPT, stop)
    return integrity.leakage_matrix(df, keys, "part")


def test_injected_text_is_caught(spark):
    clean = [("alpha one", "train"), ("beta two", "val"), ("gamma three", "test")]
    m = matrix(parted(spark, clean))
    assert m.count() == 18 and m.agg(F.sum("n_shared")).first()[0] == 0
    integrity.assert_no_leakage(m)
    with pytest.raises(AssertionError, match="train&test"):
        integrity.assert_no_leakage(matrix(parted(spark, [*clean, ("alpha one", "test")])))


def test_lossy_collision_is_fatal_only_when_fail_closed(spark):
    rows = [("alpha the one", "train"), ("alpha one", "test"), ("other", "val")]
    m = matrix(parted(spark, rows), ["the"])
    assert {(r.view, r.pair): r.n_shared for r in m.collect()}[("mhamed", "train&test")] == 1
    integrity.assert_no_leakage(m)
    with pytest.raises(AssertionError):
        integrity.assert_no_leakage(m, fatal_all=True)


def test_empty_table_still_lists_all_zeros(spark):
    df = parted(spark, [("x", "train")]).filter("id < 0")
    assert matrix(df).count() == 18


def test_leakage_by_fold_with_many_folds(spark):
    k = 45  # needs three masks
    rows = [(0, "same", ["train"] * 44 + ["test"]), (1, "same", ["val"] + ["train"] * 43 + ["val"]), (2, "other", ["test"] * 45)]
    df = spark.createDataFrame(rows, "id int, text string, parts array<string>")
    keyed = dedup.text_keys(df, "text", ["id", "text", "parts"], ANY_SCRIPT)
    out = integrity.leakage_by_fold(keyed, integrity.representation_keys("text", ANY_SCRIPT), "parts", k)
    hits = {(r.fold, r.pair): r.n_shared for r in out.filter("view = 'uid'").collect() if r.n_shared}
    assert hits == {(0, "train&val"): 1, (44, "val&test"): 1}


def test_digest_ignores_order_and_sees_duplicates_and_tampering(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, t string")
    d = integrity.content_digest(df, ["id", "t"]).collect()
    assert d == integrity.content_digest(df.repartition(3).orderBy(F.desc("id")), ["id", "t"]).collect()
    twice = df.union(df)
    assert integrity.content_digest(twice, ["id", "t"]).first().fp_xor == 0
    assert integrity.content_digest(twice, ["id", "t"]).first().fp_sum != d[0].fp_sum
    tampered = df.withColumn("t", F.coalesce("t", F.lit("")))
    assert integrity.content_digest(tampered, ["id", "t"]).collect() != d


@pytest.mark.parametrize("parts", [1, 7])
def test_range_rank_equals_row_number_and_numbers_the_groups(spark, parts):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i % 4, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, k long").repartition(parts)
    got = range_rank(df, ["g"], [F.col("v").desc(), F.col("k").asc()], total="n", group_no="no").collect()
    want = {}
    for no, g in enumerate([None, "g0", "g1", "g2"]):
        own = sorted((-v, k) for h, v, k in rows if h == g)
        want |= {k: (place, len(own), no) for place, (_, k) in enumerate(own, start=1)}
    assert {r.k: (r["rank"], r.n, r.no) for r in got} == want
    empty = range_rank(df.limit(0), ["g"], [F.col("k").asc()], total="n", group_no="no")
    assert empty.collect() == [] and empty.columns == ["g", "v", "k", "n", "no", "rank"]


@pytest.mark.parametrize("order", [["c", "k"], ["c"]])
def test_ranges_of_one_constant_value_are_even(spark, order):
    """A unique id, or nothing but the row's place, cuts what one value would keep together."""
    df = spark.range(40_000).select(F.lit("x").alias("c"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small ranges are joined up
    try:
        dealt = dealt_in_order(df, [F.col(c).asc() for c in order])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt.groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 40_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)
