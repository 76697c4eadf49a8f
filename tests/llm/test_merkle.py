"""Merkle manifest against a plain tree built in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelloom.llm import merkle

SCHEMA = "doc_id long, source string, text string, id long, tree int, carry string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(digests, fan):
    """Root of a list of digests, and for each of them its (left, right) texts upwards."""
    steps, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for own, p in zip(steps, place, strict=True):
            run, at = runs[p // fan], p % fan
            own.append(("".join(run[:at]), "".join(run[at + 1 :])))
        level, place = [sha("".join(r)) for r in runs], [p // fan for p in place]
    return (level[0] if level else None), steps


def brute(rows, fan=3):
    groups = {}
    for doc_id, source, text, *_ in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, framed(doc_id, source, text), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s])], fan) for s in order}
    root, above = climb([trees[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, above, strict=True):
        for r, steps in zip(sorted(groups[s]), trees[s][1], strict=True):
            out.append((r[3], r[2], trees[s][0], root, tuple(steps + top)))
    return sorted(out, key=str)


def run(spark, rows, fan=3):
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select("doc_id", "source", merkle.record([F.col(c) for c in ("doc_id", "source", "text")]).alias("leaf"), "id", "tree")
    got = merkle.prove(leaves, fan=fan)
    text = F.transform("steps", lambda s: F.struct(merkle.hexed(s["left"]), merkle.hexed(s["right"])))
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps")))
    assert got.where("folded <> root").isEmpty()
    return sorted([(r.id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.s))) for r in got.select(
        "id", *[merkle.hexed(c).alias(c) for c in ("leaf", "subroot", "root")], text.alias("s")).collect()], key=str)


def table(kind):
    r = random.Random(kind)
    if kind == "empty":
        return []
    if kind == "one":
        return [(7, "a", "x", 1, 1, "c")]
    if kind == "lone sources":
        return [(i, f"s{i:02d}", "t", i, 0, "") for i in range(11)]
    texts = [None, "", "-", "ä\nö", "x" * 3_000_000, "0:", "y"]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "b", "Z", "é", "a"]), r.choice(texts), 1, 2, "c")
            for _ in range(130)]
    return rows + rows[:20] + [(100 + i, "a", "copy", 0, 0, None) for i in range(90)]


@pytest.mark.parametrize("kind,fan", [("empty", 3), ("one", 3), ("lone sources", 3), ("odd rows", 3), ("pairs", 2)])
def test_proofs_equal_a_plain_tree(spark, kind, fan):
    """Null ids, sources and texts, repeated rows, empty and very long texts, clashing further columns."""
    rows = table(kind)
    assert run(spark, rows, fan) == brute(rows, fan)


def test_hot_nodes_are_met_in_several_copies(spark, monkeypatch):
    """With few leaves a copy, every node above the lowest is copied; the proofs stay the same."""
    monkeypatch.setattr(merkle, "SALT", 2)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", f"t{i}", 0, 0, None) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_only_untouched_rows_verify(spark):
    rows = [(i, f"s{i % 2}", f"t\n{i}", 0, 0, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    leaves = df.select("doc_id", "source", merkle.record([F.col("text")]).alias("leaf"), merkle.record([changed]).alias("found"))
    got = merkle.prove(leaves, carry=["found"])
    got = got.withColumn("ok", merkle.fold(F.col("carry.found"), F.col("steps")) == F.col("root"))
    assert {r.id for r in got.collect() if not r.ok} == set(range(0, 20, 3))
