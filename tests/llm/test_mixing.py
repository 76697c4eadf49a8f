"""Mixing: exact against SQL, targets, shards, draws."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import mixing, queries
from tests.oracle import compare, duck


def test_query_against_sql(spark, sf_dir):
    message, ok = compare(spark, duck(sf_dir), "op6_mix_sources", queries.QUERIES["op6_mix_sources"],
                          queries.ORACLES["op6_mix_sources"], sf_dir)
    assert ok, message


def level_targets(sizes, weights, share, limit):
    """Targets by sharing the excess again and again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = total
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += part[s]
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for n, source in ((400, "b"), (30, "a"), (3, "é"), (5, None), (2, "zero"), (60, "c")):
        rows += [(len(rows) + i, " ".join(["w"] * (0 if source == "zero" else 1 + (i * 7) % 23)), source) for i in range(n)]
    rows += [(7, None, "a"), (None, "x y z", "c"), (None, "x y z", "c"), (9, "dup dup", "b"), (9, "dup dup", "b")]
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")


def test_targets_draws_and_shards(spark, corpus):
    rows = mixing.mix(corpus, block_docs=16, levels=3).collect()
    assert len(rows) == corpus.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.draws)
        largest[r.source] = max(largest[r.source], r.size)
        assert len(r.draws) <= 2 and [d.copy for d in r.draws] == list(range(len(r.draws)))
        assert all(0 <= d.shard < 8 for d in r.draws)
    want = level_targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    for s, words in taken.items():
        assert abs(words - want[s]) <= largest[s]
    again = mixing.mix(corpus.repartition(7), block_docs=16, levels=3).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, [tuple(d) for d in r.draws]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_drawn_rows_repeat_whole_input_rows(spark, corpus):
    out = mixing.drawn(corpus, block_docs=16, levels=2)
    assert out.columns == corpus.columns
    times = Counter(tuple(r) for r in out.collect())
    inputs = {tuple(r): n for r, n in Counter(tuple(r) for r in corpus.collect()).items()}
    assert set(times) <= set(inputs) and all(n <= 2 * inputs[r] for r, n in times.items())


def test_tree_splits_quotas_exactly(spark):
    quotas = {0: 50, 1: 7, 2: 0, 3: 200, 4: 1}
    for seed in range(3):
        df = spark.createDataFrame(list(quotas.items()), "no int, quota long")
        ends = {r.no: r.ends for r in mixing.split_quotas(df, 3, seed).collect()}
        shards = defaultdict(int)
        for no, e in ends.items():
            assert e[-1] == quotas[no] and list(e) == sorted(e) and len(e) == 8
            for i in range(8):
                shards[i] += e[i] - (e[i - 1] if i else 0)
        assert max(shards.values()) - min(shards.values()) <= 1


def test_hypergeometric_has_the_right_law(spark):
    u = F.col("id") / 2000.0 + 1 / 4000.0
    for good, bad, draws in ((5, 7, 4), (300, 900, 100), (3, 0, 2), (0, 4, 2)):
        x = mixing.hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(draws).cast("long"), u)
        got = spark.range(2000).select(x.alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
        n = good + bad
        mean = draws * good / n
        assert got[0] == pytest.approx(mean, abs=0.02) and max(0, draws - bad) <= got[2] <= got[3] <= min(good, draws)
        assert got[1] == pytest.approx(mean * (bad / n) * (n - draws) / max(n - 1, 1), rel=0.03, abs=0.02)


def test_empty_table(spark, corpus):
    assert mixing.mix(corpus.limit(0)).collect() == [] and mixing.drawn(corpus.limit(0)).collect() == []
