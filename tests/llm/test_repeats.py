"""Substring de-duplication against brute force."""

import hashlib
import random

import pytest

from labelloom.llm import queries, repeats


def brute(rows, window):
    """``doc_id, text`` rows to ``(doc_id, n_words, n_removed, kept)``: repeats start earlier by (id, place)."""
    places = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: -(2**63) if i is None else i
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            places[k] = min(places.get(k, (order(i), s)), (order(i), s))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if places[tuple(w[s : s + window])] < (order(i), s):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 2)
    shared = [[word() for _ in range(n)] for n in (20, 25, 60, 19)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 40))]
        for s in r.sample(shared, r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = s
        rows.append((i, " ".join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, " ".join(["x"] * 90)), (103, None), (104, ""), (None, rows[7][1]),
             (None, rows[7][1]), (5, rows[9][1]), (105, rows[5][1] + "  tail\n\tend")]
    return rows


@pytest.mark.parametrize(("window", "base"), [(20, 5), (8, 4), (12, 3)])
def test_same_as_brute_force(spark, window, base):
    rows = texts(window)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(5)
    got = repeats.remove_repeats(docs, window=window, base=base).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, window)


def test_small_chunks_make_no_difference(spark, monkeypatch):
    rows = texts(1)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 20)


def test_query_on_the_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows, 20)}
    got = queries.QUERIES["op2_repeats"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(rows)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_longest_repeats(spark):
    r = random.Random(4)
    run = [f"w{r.random()}" for _ in range(50)]
    other = [f"v{r.random()}" for _ in range(10)]
    docs = [(1, " ".join(run)), (2, " ".join(other + run)), (3, " ".join(other))]
    got = repeats.longest_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=20).collect()
    longest = {(x.doc_id, x.start): x.length for x in got}
    assert longest[1, 0] == 40 and longest[2, 10] == 40 and longest[1, 30] == 20 and (3, 0) not in longest


def test_windows_that_differ_in_one_confusable_word_are_no_repeats(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{shared} {word}"), (2, f"{shared} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{shared} {word}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
