"""Ranked search against scoring every document for every query."""

import math
import random
import re

import numpy as np
import pytest

from labelloom.llm import ranked_search
from labelloom.llm.ranked_search import Slice, cover

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        asked = sorted(set(terms(text)))
        scores = []
        for d, t in split:
            score = 0
            for term in asked:
                tf = t.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n_docs) // total)))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **settings):
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, rank int, item_id string, score int")
    i = spark.createDataFrame([(*r, 1, 5) for r in items], "item_id long, text string, doc_id int, n int")
    return sorted([tuple(r) for r in ranked_search.search(d, i, k=k, **settings).collect()], key=str)


def table(kind):
    r = random.Random(kind)
    words = [f"w{i}" for i in range(60)] + ["été", "Ünder", "x9", "日本"]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: r.choice([" ", "-", "\n", "_"]).join(r.choices(words, weight, k=n))
    docs = [(i if i % 7 else None, text(r.randint(1, 40))) for i in range(250)]
    items = [(i, text(r.randint(1, 15))) for i in range(12)]
    if kind == "odd":
        docs += [(500, None), (501, ""), (502, " ... "), (503, "w1 " * 40_000), *docs[:40], *[(600 + i, "w5 w6 w7") for i in range(30)]]
        items += [(90, None), (91, ""), (92, "unknown terms"), (93, "W5, w6!"), (93, "W5, w6!"), (None, "w7"), (94, text(3000))]
    return docs, items


@pytest.mark.parametrize("kind,slice_size,block", [("plain", 300, 1 << 22), ("odd", 1 << 20, 1 << 22), ("odd", 90, 4000)])
def test_equals_brute_force(spark, kind, slice_size, block):
    """Ties, null and repeated ids, null, empty and long texts, queries without a match or asked twice, several blocks of
    queries, several slices, clashing further columns."""
    docs, items = table(kind)
    assert run(spark, docs, items, slice_size=slice_size, block=block) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = table("plain")
    assert run(spark, [], items[:2]) == [] and run(spark, docs[:5], []) == []


def test_cover_is_the_least_sum_of_bounds():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 7)
        joint = {(i, i): r.randint(0, 20) for i in range(n)}
        joint |= {(i, i + 1): r.randint(0, joint[i, i] + joint[i + 1, i + 1]) for i in range(n - 1) if r.random() < 0.8}

        def least(i):
            if i >= n:
                return 0
            best = joint[i, i] + least(i + 1)
            if i + 1 < n:
                best = min(best, max(joint.get((i, i + 1), 0), joint[i, i], joint[i + 1, i + 1]) + least(i + 2))
            return best

        units, bounds = cover(list(range(n)), joint)
        assert sorted(t for u in units for t in u) == list(range(n)) and sum(bounds) == least(0)


def test_bounds_skip_documents():
    """Pair bounds leave fewer documents to score than bounds on single terms, and lose none of the best."""
    r = np.random.default_rng(0)
    n_docs, n_terms = 4000, 12
    held = r.random((n_terms, n_docs)) < np.linspace(0.5, 0.01, n_terms)[:, None]
    held[1] &= ~held[0]  # two frequent terms that never meet
    impact = np.where(held, r.integers(1, 10, (n_terms, n_docs)) * np.arange(1, n_terms + 1)[:, None] ** 2, 0)
    term, doc = np.nonzero(held)
    part = Slice(np.arange(n_docs), np.zeros(n_docs, bool), doc, impact[held], np.searchsorted(term, np.arange(n_terms + 1)))
    joint = {(t, t): int(impact[t].max()) for t in range(n_terms)}
    single = joint | {(t, t + 1): joint[t, t] + joint[t + 1, t + 1] for t in range(n_terms - 1)}
    for t in range(n_terms - 1):
        both = held[t] & held[t + 1]
        joint[t, t + 1] = int((impact[t] + impact[t + 1])[both].max()) if both.any() else 0
    total = impact.sum(axis=0)
    floor = int(np.sort(total)[-10])
    reached = []
    for bounds in (joint, single):
        units, b = cover(list(range(n_terms)), bounds)
        docs, scores = ranked_search.scored(ranked_search.Query(units, np.array(b), 0), part, part.largest(), floor, 10)
        assert set(np.flatnonzero(total >= floor)) <= set(docs.tolist()) and (scores == total[docs]).all()
        reached.append(sum(b))
    assert reached[0] < reached[1]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "LONG", 50)
    text = " ".join(f"t{i % 30}" for i in range(500)).encode()
    number = {f"t{i}".encode(): i for i in range(30)}
    n, term, tf = ranked_search.counts(text, number)
    assert n == 500 and term.tolist() == list(range(30)) and tf.sum() == 500 and tf.max() == 17
