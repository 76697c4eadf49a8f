"""Rules, both votes and their ties, against brute force and hand-worked rows."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import weak
from labelloom.operators.lexicon import lexicon_signals, lexicons_from_table
from labelloom.operators.rules import (
    ABSTAIN, CONTEXT, LEXICONS, NEGATIVE, NEUTRAL, RULES, Rule, apply_rules, counted_lexicons, votes_long,
)

WORDS = [f"{a}{b}" for a in "kmnrst" for b in "aeiou"]
LEX = {name: [WORDS[(2 * i) % 30], WORDS[(2 * i + 1) % 30], WORDS[(2 * i) % 30] + WORDS[(5 * i) % 30]]
       for i, name in enumerate(LEXICONS)}


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS + [" ", " "], k=rng.randint(0, 8))) for _ in range(n)]


def frame(spark, ts):
    return spark.createDataFrame(list(enumerate(ts)), "i int, t string")


def test_signals_match_brute_force(spark):
    ts = texts(200) + ["", "ka" * 50]
    counted = counted_lexicons(RULES)
    rows = lexicon_signals(frame(spark, ts), "t", LEX, counted).orderBy("i").collect()
    for r, t in zip(rows, ts):
        for n, terms in LEX.items():
            assert r[f"has_{n}"] == any(x in t for x in terms)
            if n in counted:
                assert r[f"n_{n}"] == sum(x in t for x in terms)
        assert r.word_count == len(t.split())


def test_rule_preset_is_complete():
    assert len(RULES) == 40 and len({r.name for r in RULES}) == 40
    assert [sum(r.vote == v for r in RULES) for v in (0, 1, 2)] == [20, 10, 10]
    assert set(NEGATIVE) | set(CONTEXT) <= set(LEXICONS)


def test_empty_text_votes_neutral_by_the_short_rule(spark):
    row = apply_rules(frame(spark, [""]), "t", LEX, RULES, ["i"]).collect()[0]
    assert [r.name for r, v in zip(RULES, row.votes) if v != ABSTAIN] == ["lf_short_clean"]


def test_rule_with_a_column_of_the_user(spark):
    rules = [Rule("long", 1, where=lambda: F.length("t") > 3), Rule("any", 0)]
    got = apply_rules(frame(spark, ["ka", "kakaka"]), "t", {}, rules, ["i"]).orderBy("i").collect()
    assert [list(r.votes) for r in got] == [[-1, 0], [1, 0]]


def votes(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, votes array<tinyint>")


MATRIX = [
    [-1, -1, -1, -1],       # no vote
    [2, 0, 0, 2],           # tie: class 2 voted first
    [-1, 1, 0, -1],         # tie: class 1 voted first
    [0, 1, 1, -1],          # majority
    [2, -1, -1, -1],
]


def test_majority_ties_go_to_the_first_vote(spark):
    rows = weak.majority_vote(votes(spark, MATRIX), 3, NEUTRAL).orderBy("i").collect()
    assert [r.mv_label for r in rows] == [2, 2, 1, 1, 2]
    assert [round(r.mv_conf, 6) for r in rows] == [0.0, 0.5, 0.5, 0.666667, 1.0]


def test_weighted_vote_ties_go_to_the_lower_class(spark):
    w = F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0)])
    rows = weak.weighted_vote(votes(spark, MATRIX), w, 3, NEUTRAL).orderBy("i").collect()
    assert [r.wv_label for r in rows] == [2, 0, 0, 1, 2]
    assert [r.wv_novote for r in rows] == [1, 0, 0, 0, 0]


def test_weights_and_votes_match_brute_force(spark):
    rng = random.Random(5)
    m, rows = 6, [[rng.choice([-1, -1, -1, v % 3]) for v in range(6)] for _ in range(500)]
    cov = [sum(r[j] != -1 for r in rows) / len(rows) for j in range(m)]
    inv = [1 / (c + 0.005) for c in cov]
    w = [x / sum(inv) * m for x in inv]
    df = votes(spark, rows)
    got = weak.rule_weights(df, [f"r{j}" for j in range(m)]).orderBy("rule").collect()
    assert [r.weight for r in got] == pytest.approx(w, rel=1e-12)
    out = weak.fit_and_vote(df, [f"r{j}" for j in range(m)], 3, NEUTRAL).orderBy("i").collect()
    for r, v in zip(out, rows):
        score = [sum(w[j] for j in range(m) if v[j] == c) for c in range(3)]
        total = sum(score)
        assert r.wv_label == (score.index(max(score)) if total else NEUTRAL)
        assert r.wv_conf == pytest.approx(max(score) / total if total else 0.0)


def test_fitting_on_train_ignores_the_other_rows(spark):
    rows = [[0, -1], [0, 1], [-1, 1], [2, 2]]
    df = votes(spark, rows)
    fitted = weak.rule_weights(df.filter("i < 2"), ["a", "b"])
    again = weak.rule_weights(votes(spark, rows[:2] + [[-1, -1]] * 2).filter("i < 2"), ["a", "b"])
    assert fitted.orderBy("rule").collect() == again.orderBy("rule").collect()


def test_summary_and_long_form(spark):
    df = votes(spark, MATRIX)
    s = weak.matrix_summary(df).collect()[0]
    assert (s.n_texts, s.any_vote, s.no_vote, s.conflicts) == (5, 4, 1, 3)
    rules = [Rule(f"r{j}", 0) for j in range(4)]
    assert votes_long(df, rules, ["i"]).count() == 20


def test_review_plan_boundaries(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.59, 0.6, 0.7, 0.79, 0.8, 1.0)], "c double")
    r = weak.review_plan(df, "c").collect()[0]
    assert (r.high, r.medium, r.low, r.effort) == (2, 3, 2, 2)


def test_lexicon_table_keeps_repeated_entries_and_stays_in_the_plan(spark):
    t = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "z"), ("a", "x"), ("a", None)], "lexicon string, term string")
    docs = spark.createDataFrame([(1, "xz"), (2, "y"), (3, None)], "id long, text string")
    sig = lexicon_signals(docs, "text", lexicons_from_table(t, ["a", "b", "none"]), ["a"])
    got = {r.id: (r.n_a, r.has_a, r.has_b, r.has_none) for r in sig.collect()}
    assert got == {1: (2, True, True, False), 2: (1, True, False, False), 3: (0, False, False, False)}
    assert "Python" not in sig._jdf.queryExecution().toString()
