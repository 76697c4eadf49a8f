"""The record of all selections, and what is read under it."""

import pytest
from pyspark.sql import functions as F

from labelloom.functions.staging import fresh_path
from labelloom.plans import evaluation as P
from labelloom.plans import selections as S

SYSTEMS = ("a", "b", "c")
PLAN = P.EnsemblePlan(SYSTEMS, 2, (1, 2), size=2, exhaustive=True)
EXPECTED = ["best_single_t", "teacher_x_t", "ensemble_t"]


def predictions(spark, good="b"):
    rows = []
    for k, s in enumerate(SYSTEMS):
        for seed in (1, 2):
            for split in ("val", "test"):
                for i in range(40):
                    right = s == good or (i * 7 + k + seed) % 3 > 0
                    p = 0.9 if (i % 2 == 1) == right else 0.1
                    rows.append((s, seed, split, f"u{i}", i % 2, [1 - p, p]))
    return spark.createDataFrame(rows, "system string, seed int, split string, uid string, y int, probs array<double>")


def gathered(spark, good="b"):
    return S.gather(predictions(spark, good), "t", PLAN, {"x": ["c", "a"]}, "inputs")


def test_families_follow_the_selections(spark):
    declared = spark.createDataFrame([("t", "@ensemble", "@best_single"), ("t", "@best_single", "a"), ("t", "@none", "a"), ("u", "a", "b"),
                                      ("t", "a", "a")], "task string, a string, b string")
    seen = {}
    for good in ("b", "c", "a"):
        record = S.freeze(gathered(spark, good), fresh_path(spark, "frozen"), EXPECTED)
        seen[good] = {(r.task, r.a, r.b) for r in S.comparison_families(record, declared).collect()}
        assert ("t", good, "a") in seen[good] or good == "a"
    assert len({frozenset(v) for v in seen.values()}) == 3 and all(("u", "a", "b") in v for v in seen.values())


def test_the_record_is_written_once_and_complete(spark):
    chosen, path = gathered(spark), fresh_path(spark, "frozen")
    with pytest.raises(RuntimeError, match="missing: other_t"):
        S.freeze(chosen, path, [*EXPECTED, "other_t"])
    with pytest.raises(RuntimeError, match="no selection is frozen"):
        S.frozen_record(spark, path)
    first = S.freeze(chosen, path, EXPECTED).orderBy("name").collect()
    assert S.freeze(chosen, path, EXPECTED).orderBy("name").collect() == first
    assert S.frozen_record(spark, path).count() == 3
    changed = chosen.withColumn("chosen", F.when(F.col("role") == "best_single", "a").otherwise(F.col("chosen")))
    with pytest.raises(RuntimeError, match="best_single_t changed"):
        S.freeze(changed, path, EXPECTED)


def test_test_rows_need_an_unbroken_freeze(spark):
    chosen = gathered(spark)
    record = S.freeze(chosen, fresh_path(spark, "frozen"), EXPECTED)
    test = predictions(spark).filter("split = 'test'")
    ens = S.materialise(test, record, chosen, "t", 2)
    row = ens.first()
    assert ens.count() == 80 and row.system == "ens" and len(row.logits) == 2
    members = chosen.filter("role = 'ensemble'").first().chosen.split("|")[0]
    assert "b" in members.split("+")
    changed = chosen.withColumn("chosen", F.when(F.col("role") == "teacher_x", "zzz").otherwise(F.col("chosen")))
    with pytest.raises(Exception, match="test data stays closed"):
        S.materialise(test, record, changed, "t", 2).collect()
    with pytest.raises(Exception, match="test data stays closed"):
        S.materialise(test, record, chosen.filter("role <> 'best_single'"), "t", 2, members=["a", "b"]).collect()
    with pytest.raises(RuntimeError, match="no ensemble of u"):
        S.materialise(test, record, chosen, "u", 2)
