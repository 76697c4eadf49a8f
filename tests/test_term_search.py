"""Blocks of terms searched in Arrow batches against plain search."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from labelloom.operators import term_join
from labelloom.operators import term_search as S


def counted(texts, terms, whole):
    """By the searched block and by plain search; the terms of a profile have numbers that are equal modulo five."""
    half = len(terms) // 2
    encoded = [pa.array([t.encode() for t in part], pa.binary()) for part in (terms[:half], terms[half:])]
    profile = pa.array([i % 5 * 10 for i in range(len(terms))], pa.int64())
    block = S.Terms.of([pa.RecordBatch.from_arrays([e, p], names=["term", "profile"])
                        for e, p in zip(encoded, (profile[:half], profile[half:]), strict=True)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    got = Counter()
    third = len(texts) // 3
    for batch in S.counter(SimpleNamespace(value=block), whole)([rows.slice(0, third), rows.slice(third)]):
        for i, p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[i, p] += k
    want = Counter((i, j % 5 * 10) for i, text in enumerate(texts) for j, term in enumerate(terms) if term in text)
    return got, want


@pytest.mark.parametrize("cut", [{}, {"SLICE": 50}, {"STEP": 64, "PLACES": 100}, {"HELD": 30}, {"LONG": 6}, {"_FILTER": np.uint64(60)}])
def test_blocks_equal_plain_search(monkeypatch, cut):
    """Terms of 0 to 1,800 bytes, letters of one to four bytes, zero bytes, empty texts and texts longer than a slice."""
    for name, value in cut.items():
        monkeypatch.setattr(S, name, value)
    for seed, letters in enumerate(("ab ", "abé日𝒳 ", "a\0 ", "abcdefgh ")):
        r = random.Random(seed)
        word = lambda n: "".join(r.choice(letters) for _ in range(n))  # noqa: B023, E731
        texts = [word(r.randint(0, r.choice([5, 60, 300]))) for _ in range(60)] + ["", "ab" * 2000, " "]
        parts = [(t, r.randint(0, len(t)), r.randint(1, 45)) for t in r.choices(texts, k=60)]
        terms = {word(r.randint(0, 7)) for _ in range(80)} | {t[a:a + n] for t, a, n in parts} | {"a" * k for k in range(40)} | {"ab" * 900}
        terms = r.sample(sorted(terms), len(terms))
        got, want = counted(texts, terms, True)
        assert got == want
        got, want = counted(texts, [t for t in terms if " " not in t], False)
        assert got == want


def test_a_term_that_differs_in_one_byte_is_no_hit(monkeypatch):
    """Equal values are not taken for equal bytes."""
    monkeypatch.setattr(S, "scramble", lambda x: x * np.uint64(0))
    base = "abcdefghijklmnopqrstuvwxyz"
    terms = [base[:i] + "X" + base[i + 1:] for i in range(8, 26)] + [base]
    texts = [base, base[:20], f"{terms[3]}-{base}", f"{base}a {base}b {base}"]
    for whole in (True, False):
        got, want = counted(texts, terms, whole)
        assert got == want and sum(want.values()) == 4


def test_empty_blocks_and_tables():
    for whole in (True, False):
        assert counted(["a b", ""], [], whole) == ({}, {})
        assert counted(["a b", ""], [""], whole)[0] == {(0, 0): 1, (1, 0): 1}
        assert counted([], ["a", "b"], whole) == ({}, {})


def test_a_list_is_searched_in_blocks_and_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(term_join, "TERMS", 4)
    plans = []
    write = term_join.stage

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(term_join, "stage", seen)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    docs = [(i, " ".join(word(r.randint(1, 9)) for _ in range(8))) for i in range(30)]
    terms = sorted({("l0", word(r.randint(1, 5))) for _ in range(40)}) + [("l1", "a b"), ("l1", "a b")]
    got = term_join.listed_terms(
        spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame(terms, "lexicon string, term string"))
    want = Counter((i, lexicon) for i, text in docs for lexicon, term in terms if term in text)
    assert {(x.k, x.lexicon): x.n for x in got.collect()} == want
    passes = [plan for name, plan in plans if name == "term-counts"]
    assert len(passes) >= 4 and not any("Exchange" in plan for plan in passes)
    assert not any("text" in line for _, plan in plans for line in plan.splitlines() if "Exchange" in line)
