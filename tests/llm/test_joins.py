"""Similarity join and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from labelloom.llm import graph, jaccard_join, queries


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    """Components by comparing all pairs; rows sharing an id are one document."""
    order = lambda i: -(2**63) if i is None else i
    sets = [(order(i), shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    out = []
    for (i, t), (o, s) in zip(rows, sets, strict=True):
        c = top(o) if s else o
        out.append((i, len(s), None if c == -(2**63) else c))
    return sorted(out, key=str)


def family(r, base, edits, count):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(w))
            if r.random() < 0.5:
                w[at] = f"n{r.randrange(40)}"
            else:
                del w[at]
        out.append(" ".join(w))
    return out


def corpus(seed, size, edits, count):
    r = random.Random(seed)
    rows = []
    for _ in range(4):
        base = [f"w{r.randrange(500)}" for _ in range(size)]
        rows += family(r, base, edits, count)
    rows += ["", None, "one", "ONE", "one two", "Two  one", "a b c", "A b\tC", "a b c a b c"]
    rows = list(enumerate(rows))
    rows += [(None, rows[0][1]), (7, rows[30][1]), (500, rows[3][1]), (501, rows[3][1].upper())]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent", "size", "edits"), [
    (3, 90, 150, 6), (5, 80, 120, 10), (1, 50, 30, 12)])
def test_same_components_as_all_pairs(spark, n, percent, size, edits):
    rows = corpus(size, size, edits, 40)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, size int").repartition(6)
    got = jaccard_join.link(docs, n=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)


def test_groups_larger_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    rows = corpus(5, 150, 6, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.link(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(1)
    for percent in (50, 80, 90, 95):
        for size in (3, 10, 40, 41, 120, 700):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(20):
                keep = r.random(len(a)) > (100 - percent) / 220
                b = np.unique(np.concatenate((a[keep], r.integers(0, 2**63, r.integers(0, 3), dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if common == len(a) == len(b) or 100 * common < percent * (len(a) + len(b) - common):
                    continue
                both = np.concatenate((a, b))
                sig, owner = jaccard_join.signatures(both, np.array([0, len(a), len(both)]), percent)
                assert set(sig[owner == 0]) & set(sig[owner == 1]), (percent, size)


def test_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((a[: r.integers(0, len(a)) + 1], r.integers(0, 2**63, r.integers(0, 90), dtype=np.uint64))))
        two = jaccard_join.folded([jaccard_join.bitmap(a), jaccard_join.bitmap(b)])
        assert int(np.bitwise_count(two[0] ^ two[1]).sum()) <= len(np.setxor1d(a, b))


def test_keep_one_leaves_one_row_of_each_group(spark):
    rows = corpus(9, 80, 4, 20)
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")
    kept = jaccard_join.keep_one(docs, n=5, percent=80)
    assert kept.columns == docs.columns
    groups = defaultdict(set)
    for i, _, c in brute(rows, 5, 80):
        groups[c].add(i)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_empty_table(spark):
    assert jaccard_join.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 30)] + [(1, 1), (40, 39), (39, 40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 30)) and got[40] == 39
    assert 1 not in got
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_query_on_the_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op8_jaccard_join"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


def test_words_a_polynomial_hash_confuses_are_not_linked(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame(
        [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link(docs, n=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
