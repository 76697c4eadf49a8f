"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from labelloom.llm import queries, top_inner
from tests.oracle import compare, duck


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(v)] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for (i, v), q in good.items():
        if i % every:
            continue
        held = lambda s: max(-(2**63), min(2**63 - 1, s))
        scored = [(-held(sum(a * b for a, b in zip(q, c, strict=False))), j) for (j, _), c in good.items() if j != i]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def vectors(kind):
    r = random.Random(kind)
    if kind == "units":
        rows = []
        for i in range(400):
            v = np.array([r.gauss(0, 1) for _ in range(8)])
            rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
        return rows + [(1000 + i, rows[3][1]) for i in range(5)]
    if kind == "lengths":
        return [(i, [r.gauss(0, 1) * 10 ** r.uniform(-2, 2) for _ in range(4)]) for i in range(300)]
    if kind == "close":
        return [(i, [1 + r.random() / 50, r.random() / 20, 0.0]) for i in range(300)]
    huge = [(i, [r.choice([1.0, -2.0, 3e30, 1e20]) for _ in range(3)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf")]), (104, []), (None, [1.0]),
           (105, [0.5]), (110, [0.0, 0.0, 0.0]), (110, [1.0, 1.0, 1.0]), (110, [1.0, 1.0, 1.0])]
    return huge + odd if kind == "huge" else odd + [(i, [float(i % 3), 1.0]) for i in range(20)]


@pytest.mark.parametrize("kind", ["units", "lengths", "close", "huge", "few"])
def test_same_as_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(top_inner, "BLOCK", 64)
    rows = vectors(kind)
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted(tuple(r) for r in top_inner.search(df, k=5, every=10).collect())
    want = brute(rows, 5, 10)
    assert got == want


def test_pruning_keeps_all_that_reach_the_bound():
    r = np.random.default_rng(3)
    for scale in (0.05, 1.0):
        rows = np.floor(256 * (np.array([1.0, 0.5, 0, 0]) + scale * r.normal(size=(500, 4))))
        block = top_inner.Block(np.arange(500), rows)
        for q in rows[:40]:
            score = block.rows @ q
            for bound in np.quantile(score, [0.3, 0.9, 0.99]):
                pick = block.open(q, float(np.linalg.norm(q)), float(bound))
                kept = set(range(500)) if pick is None else set(pick.tolist())
                assert set(np.flatnonzero(score >= bound).tolist()) <= kept


def test_empty_table(spark):
    assert top_inner.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_query_against_sql(spark, sf_dir):
    message, ok = compare(spark, duck(sf_dir), "op4_top_inner", queries.QUERIES["op4_top_inner"],
                          queries.ORACLES["op4_top_inner"], sf_dir)
    assert ok, message


def test_blocks_out_of_reach_get_no_row(spark):
    """The number of (query, block) rows is that of the pairs whose lengths can reach the bound."""
    r = random.Random(11)
    lengths = [math.exp(r.uniform(0, 9)) for _ in range(300)]
    number = lambda x: math.floor(math.log(max(x, 1.0)) / math.log(top_inner.RATIO))
    sizes = {}
    for x in lengths:
        sizes[number(x)] = sizes.get(number(x), 0) + 1
    first, rows = 0, []
    for b in sorted(sizes):
        rows.append((b, first, sizes[b]))  # as many blocks as vectors
        first += sizes[b]
    buckets = spark.createDataFrame(rows, "bucket int, first long, blocks long")
    queries = [(i, math.exp(r.uniform(0, 9)), r.choice([None, -5.0, *[math.exp(r.uniform(4, 18)) for _ in range(8)]])) for i in range(60)] + [(99, 0.0, 7.0)]
    got = top_inner.reachable_blocks(spark.createDataFrame(queries, "q long, length double, bound double"), buckets, first).collect()
    want = set()
    for q, length, bound in queries:
        for b, start, n in rows:
            if not (bound and bound > 0 and length > 0) or b >= number(bound / length * (1 - 1e-9)):
                want |= {(q, block) for block in range(start, start + n)}
    assert {(x.q, x.block) for x in got} == want and len(got) == len(want)
    # Nothing that can reach the bound is left out, and much else is.
    longest = {start + i: top_inner.RATIO ** (b + 1) for b, start, n in rows for i in range(n)}
    assert all((q, block) in want for q, length, bound in queries for block, x in longest.items() if not bound or length * x >= bound)
    assert len(want) < 0.8 * len(queries) * first
