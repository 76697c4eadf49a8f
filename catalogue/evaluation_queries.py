"""Metrics, ensembles, validation-only selection and paired statistics over a prediction table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalogue.base import (
    N_CLASSES, SEEDS, SQL_LABELS3, SQL_PREDICTIONS, SYSTEMS, labels3, predictions, query, table,
)
from labelloom.functions.arrays import argmax
from labelloom.functions.staging import fresh_path, stage
from labelloom.operators import ensemble as E
from labelloom.operators import metrics as M
from labelloom.operators import selection as Sel
from labelloom.operators import stats as H
from labelloom.operators.integrity import content_digest
from labelloom.plans import evaluation as P
from labelloom.plans import selections as Sels

RUN = ["system", "seed"]
TEST = "split = 'test'"


def _rounded(df, *cols, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _sql_metrics(source: str, run: str, prefix: str = "") -> str:
    """CTEs: cells -> per class -> run metrics, over a (run, y, pred) source."""
    on = " AND ".join(f"r.{c.strip()} = c.{c.strip()}" for c in run.split(","))
    return f"""
{prefix}cells AS (SELECT {run}, y, pred, count(*) AS n FROM {source} GROUP BY {run}, y, pred),
{prefix}cls AS (
  SELECT {', '.join('r.' + c.strip() for c in run.split(','))}, k.k AS cls,
    coalesce(sum(n) FILTER (WHERE c.y = k.k), 0)::BIGINT AS support,
    coalesce(sum(n) FILTER (WHERE c.pred = k.k), 0)::BIGINT AS n_pred,
    coalesce(sum(n) FILTER (WHERE c.y = k.k AND c.pred = k.k), 0)::BIGINT AS tp
  FROM (SELECT DISTINCT {run} FROM {prefix}cells) r CROSS JOIN (VALUES (0), (1), (2)) k(k)
  JOIN {prefix}cells c ON {on} GROUP BY ALL),
{prefix}pcls AS (
  SELECT *, CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (n_pred + support) ELSE 0 END AS f1 FROM {prefix}cls),
{prefix}runm AS (
  SELECT {run}, sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
  FROM {prefix}pcls GROUP BY {run})"""


SQL_ALL = f"WITH {SQL_PREDICTIONS}, {_sql_metrics('preds', 'system, seed, split')}"
SQL_TEST_M = f"WITH {SQL_PREDICTIONS}, {_sql_metrics('(SELECT * FROM preds WHERE ' + TEST + ')', 'system, seed')}"
SQL_VAL_M = f"WITH {SQL_PREDICTIONS}, {_sql_metrics('''(SELECT * FROM preds WHERE split = 'val')''', 'system, seed', 'v')}"
SQL_SINGLE = SQL_VAL_M + """,
single AS (SELECT system, avg(macro_f1) AS score, CAST(substr(system, 2) AS INTEGER) AS position FROM vrunm GROUP BY system)"""

FOUR = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


def cells(spark, sf, run=("system", "seed", "split")):
    return M.confusion_cells(M.predicted(predictions(spark, sf)), list(run))


def test_scores(spark, sf):
    p = predictions(spark, sf).filter(F.col("split") == "test")
    return P.run_scores(p, RUN, N_CLASSES)


def plan(exhaustive=True):
    return P.EnsemblePlan(SYSTEMS, N_CLASSES, SEEDS, size=3, exhaustive=exhaustive)


# ------------------------------------------------------------------------------- metrics
@query("confusion_matrix", SQL_ALL + """,
runs AS (SELECT DISTINCT system, seed, split FROM cells)
SELECT r.system, r.seed, r.split, a.k::INTEGER AS y, b.k::INTEGER AS pred, coalesce(c.n, 0) AS n
FROM runs r CROSS JOIN (VALUES (0), (1), (2)) a(k) CROSS JOIN (VALUES (0), (1), (2)) b(k)
LEFT JOIN cells c ON c.system = r.system AND c.seed = r.seed AND c.split = r.split AND c.y = a.k AND c.pred = b.k""")
def confusion_matrix(spark, sf):
    run = ["system", "seed", "split"]
    return M.confusion_matrix(cells(spark, sf), run, N_CLASSES)


@query("per_class_metrics", SQL_ALL + """
SELECT system, seed, split, cls::INTEGER AS cls, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, support, n_pred, tp FROM pcls""")
def per_class_metrics(spark, sf):
    return _rounded(M.per_class(cells(spark, sf), ["system", "seed", "split"], N_CLASSES), "precision", "recall", "f1")


@query("absent_class_metrics", f"""WITH {SQL_PREDICTIONS},
p4 AS (SELECT system, y, pred FROM preds)
SELECT g.system, k.k::INTEGER AS cls, count(*) FILTER (WHERE y = k.k) AS support,
  CASE WHEN k.k = 3 THEN 0.0 ELSE round(2.0::DOUBLE * count(*) FILTER (WHERE y = k.k AND pred = k.k)
    / (count(*) FILTER (WHERE y = k.k) + count(*) FILTER (WHERE pred = k.k)), 9) END AS f1
FROM p4 g CROSS JOIN (VALUES (0), (1), (2), (3)) k(k) GROUP BY g.system, k.k""")
def absent_class_metrics(spark, sf):
    """A listed class that never occurs still has its row of zeros."""
    c = M.confusion_cells(M.predicted(predictions(spark, sf)), ["system"])
    return _rounded(M.per_class(c, ["system"], N_CLASSES + 1), "f1").select("system", "cls", "support", "f1")


@query("macro_metrics", SQL_ALL + " SELECT system, seed, split, n, "
       + ", ".join(f"round({c}, 9) AS {c}" for c in FOUR) + " FROM runm")
def macro_metrics(spark, sf):
    run = ["system", "seed", "split"]
    return _rounded(M.run_metrics(cells(spark, sf), run, N_CLASSES), *FOUR)


@query("metric_mean_sd", SQL_TEST_M + " SELECT system, count(*) AS n_runs, "
       + ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 9) AS {c}_sd" for c in FOUR)
       + " FROM runm GROUP BY system")
def metric_mean_sd(spark, sf):
    return _rounded(M.mean_sd(test_scores(spark, sf), ["system"], FOUR), *[f"{c}_{s}" for c in FOUR for s in ("mean", "sd")])


@query("per_class_mean_sd", SQL_TEST_M + """
SELECT system, cls::INTEGER AS cls, count(*) AS n_runs, """
       + ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 9) AS {c}_sd" for c in ("precision", "recall", "f1"))
       + " FROM pcls GROUP BY system, cls")
def per_class_mean_sd(spark, sf):
    p = predictions(spark, sf).filter(F.col("split") == "test")
    pc = M.per_class(M.confusion_cells(M.predicted(p), RUN), RUN, N_CLASSES)
    three = ("precision", "recall", "f1")
    return _rounded(M.mean_sd(pc, ["system", "cls"], three), *[f"{c}_{s}" for c in three for s in ("mean", "sd")])


@query("mean_val_f1", SQL_SINGLE + " SELECT system, round(score, 9) AS score, position FROM single")
def mean_val_f1(spark, sf):
    return _rounded(P.single_scores(predictions(spark, sf), plan()), "score")


@query("system_catalogue", f"""WITH {SQL_PREDICTIONS},
s AS (SELECT *, concat(system, '__s', CAST(seed AS VARCHAR)) AS run_id FROM preds)
SELECT c.name AS system, count(DISTINCT run_id) AS n_runs, count(*) AS n FROM s
JOIN (VALUES ('base:m0', '^m0__s.*$'), ('first seed', '^m[0-9]__s42$'), ('odd', '^m[13]__s4[0-9]$')) c(name, pat)
  ON regexp_matches(s.run_id, c.pat) GROUP BY c.name""")
def system_catalogue(spark, sf):
    p = predictions(spark, sf).select(F.concat("system", F.lit("__s"), F.col("seed").cast("string")).alias("run_id"))
    named = M.systems_from_patterns(
        p, "run_id", {"base:m0": "m0__s.*", "first seed": "m[0-9]__s42", "odd": "m[13]__s4[0-9]"}
    )
    per_run = named.groupBy("system", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("system").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n"))


# ------------------------------------------------------------------------------ ensembles
MEMBERS = ("m1", "m2", "m3")


def _sql_ensemble(rule: str, members=MEMBERS, source: str = "preds", weight: str = "1.0::DOUBLE") -> str:
    ms = ", ".join(f"'{m}'" for m in members)
    uni = [f"round(avg(p{c}), 12)" for c in range(3)]
    wei = [f"round(sum({weight} * p{c}) / sum({weight}), 12)" for c in range(3)]
    v = [f"count(*) FILTER (WHERE pred = {c})" for c in range(3)]
    tie = " + ".join(f"(({x}) = greatest({', '.join(v)}))::INTEGER" for x in v)
    if rule == "uniform_prob_mean":
        q = uni
    elif rule == "valf1_weighted_prob_mean":
        q = wei
    else:
        q = [f"CASE WHEN {tie} > 1 THEN {u} ELSE round(({x})::DOUBLE / {len(members)}, 12) END" for u, x in zip(uni, v)]
    return f"""SELECT split, seed, uid, max(y) AS y, {q[0]} AS q0, {q[1]} AS q1, {q[2]} AS q2
  FROM {source} WHERE system IN ({ms}) GROUP BY split, seed, uid"""


_ENS_OUT = """ SELECT split, seed, uid, y, round(q0, 9) AS q0, round(q1, 9) AS q1, round(q2, 9) AS q2,
  CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS pred FROM ens"""


def _ens_columns(df):
    return M.predicted(df).select(
        "split", "seed", "uid", "y", *[F.round(F.get("probs", F.lit(c)), 9).alias(f"q{c}") for c in range(3)], "pred"
    )


@query("ens_uniform", f"WITH {SQL_PREDICTIONS}, ens AS ({_sql_ensemble('uniform_prob_mean')})" + _ENS_OUT)
def ens_uniform(spark, sf):
    return _ens_columns(E.combine(predictions(spark, sf), MEMBERS, "uniform_prob_mean", N_CLASSES, ["split", "seed"]))


@query("ens_hard", f"WITH {SQL_PREDICTIONS}, ens AS ({_sql_ensemble('hard_majority')})" + _ENS_OUT)
def ens_hard(spark, sf):
    return _ens_columns(E.combine(predictions(spark, sf), MEMBERS, "hard_majority", N_CLASSES, ["split", "seed"]))


@query("ens_weighted", SQL_SINGLE + f""",
pw AS (SELECT p.*, s.score AS w FROM preds p JOIN single s USING (system)),
ens AS ({_sql_ensemble('valf1_weighted_prob_mean', source='pw', weight='w')})""" + _ENS_OUT)
def ens_weighted(spark, sf):
    p = predictions(spark, sf)
    w = {r.system: r.score for r in P.single_scores(p, plan()).collect()}
    return _ens_columns(E.combine(p, MEMBERS, "valf1_weighted_prob_mean", N_CLASSES, ["split", "seed"], w))


def _sql_candidates() -> str:
    subs = E.subsets(SYSTEMS, 3)
    rules = ("uniform_prob_mean", "hard_majority", "valf1_weighted_prob_mean")
    parts = []
    for i, (s, r) in enumerate((s, r) for s in subs for r in rules):
        body = _sql_ensemble(r, s, "vw", "w")
        parts.append(f"SELECT {i} AS candidate, '{'+'.join(s)}' AS members, '{r}' AS rule, e.* FROM ({body}) e")
    return " UNION ALL ".join(parts)


SQL_SELECT = SQL_SINGLE + f""",
vw AS (SELECT p.*, s.score AS w FROM preds p JOIN single s USING (system) WHERE split = 'val'),
cand AS ({_sql_candidates()}),
cpred AS (SELECT *, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS pred FROM cand),
{_sql_metrics('cpred', 'candidate, seed', 'c')},
cmean AS (SELECT candidate, round(avg(macro_f1), 12) AS f FROM crunm GROUP BY candidate),
scored AS (
  SELECT m.candidate, c.members, c.rule, round(m.f, 9) AS mean_val_macro_f1,
    row_number() OVER (ORDER BY m.f DESC, m.candidate) AS rank
  FROM cmean m JOIN (SELECT DISTINCT candidate, members, rule FROM cand) c USING (candidate))"""


@query("ensemble_select", SQL_SELECT + " SELECT candidate::INTEGER AS candidate, members, rule, mean_val_macro_f1, rank::INTEGER AS rank FROM scored")
def ensemble_select(spark, sf):
    return _rounded(P.select_ensemble(predictions(spark, sf), plan()), "mean_val_macro_f1")


@query("top_k_members", SQL_SINGLE + """
SELECT system, round(score, 9) AS score, position, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, position) AS rank FROM single) x WHERE rank <= 3""")
def top_k_members(spark, sf):
    return _rounded(Sel.top_k(P.single_scores(predictions(spark, sf), plan()), [], 3), "score")


@query("best_single", SQL_SINGLE + " SELECT system, round(score, 9) AS score FROM single ORDER BY score DESC, position LIMIT 1")
def best_single(spark, sf):
    return _rounded(Sel.best(P.single_scores(predictions(spark, sf), plan()), []), "score").select("system", "score")


@query("teacher_select", SQL_SINGLE + """,
roles AS (SELECT * FROM (VALUES ('primary', 'm0', 0), ('primary', 'm1', 1), ('primary', 'm2', 2),
  ('repro', 'm2', 0), ('repro', 'm0', 1)) r(role, system, place))
SELECT role, system, round(score, 9) AS score FROM (
  SELECT role, system, score, row_number() OVER (PARTITION BY role ORDER BY score DESC, place) AS k
  FROM roles JOIN single USING (system)) x WHERE k = 1""")
def teacher_select(spark, sf):
    """Teachers from two declared candidate lists."""
    scores = P.single_scores(predictions(spark, sf), plan()).drop("position")
    lists = {"primary": ["m0", "m1", "m2"], "repro": ["m2", "m0"]}
    out = None
    for role, cands in lists.items():
        one = Sel.listed(scores, "system", cands).withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    return _rounded(Sel.best(out, ["role"]).select("role", "system", "score"), "score")


SQL_ALPHA = SQL_SINGLE + """,
var AS (SELECT CASE WHEN system IN ('m0', 'm1') THEN 'enc0' ELSE 'enc1' END AS encoder,
  CASE WHEN system IN ('m0', 'm2') THEN '0.5' ELSE '0.7' END AS alpha, system, score FROM single),
pick AS (SELECT encoder, alpha, score FROM (
  SELECT *, row_number() OVER (PARTITION BY encoder ORDER BY score DESC, alpha) AS k FROM var) x WHERE k = 1)"""


def _variants(df):
    return df.withColumn("encoder", F.when(F.col("system").isin("m0", "m1"), "enc0").otherwise("enc1")).withColumn(
        "alpha", F.when(F.col("system").isin("m0", "m2"), "0.5").otherwise("0.7")
    )


def alpha_choice(spark, sf):
    scores = _variants(P.single_scores(predictions(spark, sf), plan()).drop("position"))
    return Sel.best(Sel.listed(scores, "alpha", ["0.5", "0.7"]), ["encoder"]).select("encoder", "alpha", "score")


@query("alpha_select", SQL_ALPHA + " SELECT encoder, alpha, round(score, 9) AS score FROM pick")
def alpha_select(spark, sf):
    return _rounded(alpha_choice(spark, sf), "score")


@query("resolve_runs", SQL_ALPHA + """
SELECT v.encoder, v.alpha, p.seed, p.uid, p.y, p.pred FROM preds p JOIN var v USING (system)
JOIN pick k ON k.encoder = v.encoder AND k.alpha = v.alpha WHERE p.split = 'test'""")
def resolve_runs(spark, sf):
    """Test predictions of the selected variant of every encoder."""
    p = _variants(predictions(spark, sf)).filter(F.col("split") == "test")
    chosen = Sel.resolve_runs(p, alpha_choice(spark, sf), ["encoder"], "alpha")
    return M.predicted(chosen).select("encoder", "alpha", "seed", "uid", "y", "pred")


TASK = "three"
TEACHERS = {"primary": ["m0", "m1", "m2"], "repro": ["m2", "m0"]}
EXPECTED = [f"{role}_{TASK}" for role in ("best_single", "teacher_primary", "teacher_repro", "ensemble")]


def frozen_selections(spark, sf):
    """The selections of the task and the written record of all of them."""
    p = predictions(spark, sf)
    inputs = content_digest(Sel.validation_only(p).withColumn("pred", argmax("probs")), ["uid", "y", "pred"]).first()
    chosen = stage(Sels.gather(p, TASK, plan(), TEACHERS, f"{inputs.n_rows}:{inputs.fp_sum}"), "selections")
    return chosen, Sels.freeze(chosen, fresh_path(spark, "frozen"), EXPECTED)


def _sql_chosen() -> str:
    """The selected ensemble over validation and test, whichever candidate it is."""
    rules = ("uniform_prob_mean", "hard_majority", "valf1_weighted_prob_mean")
    parts = [f"SELECT e.* FROM ({_sql_ensemble(r, s, 'pw', 'w')}) e WHERE {i} = (SELECT candidate FROM scored WHERE rank = 1)"
             for i, (s, r) in enumerate((s, r) for s in E.subsets(SYSTEMS, 3) for r in rules)]
    return " UNION ALL ".join(parts)


SQL_MATERIALISED = SQL_SELECT + f""",
pw AS (SELECT p.*, s.score AS w FROM preds p JOIN single s USING (system) WHERE split <> 'train'),
chosen_ens AS ({_sql_chosen()}),
fixed_ens AS ({_sql_ensemble('uniform_prob_mean', source='pw')}),
both_ens AS (SELECT 'ens' AS system, * FROM chosen_ens UNION ALL SELECT 'ensfixed', * FROM fixed_ens)"""


@query("ens_materialised", SQL_MATERIALISED + """
SELECT system, seed, split, uid, y, """ + ", ".join(
    f"round(q{c}, 9) AS p{c}, round(ln(greatest(q{c}, 1e-12)), 6) AS l{c}" for c in range(3)) + " FROM both_ens")
def ens_materialised(spark, sf):
    """The selected ensemble and one declared beforehand, over validation and test, read under the frozen record."""
    p = predictions(spark, sf)
    chosen, record = frozen_selections(spark, sf)
    weights = {r.system: r.score for r in P.single_scores(p, plan()).collect()}  # one row a candidate
    open_rows = p.filter(F.col("split") != "train")
    ens = Sels.materialise(open_rows, record, chosen, TASK, N_CLASSES, "ens", weights)
    fixed = Sels.materialise(open_rows, record, chosen, TASK, N_CLASSES, "ensfixed", members=MEMBERS)
    columns = [F.round(F.get(a, F.lit(c)), d).alias(f"{n}{c}") for c in range(3) for a, d, n in (("probs", 9, "p"), ("logits", 6, "l"))]
    return ens.unionByName(fixed).select("system", "seed", "split", "uid", "y", *columns)


@query("selection_record", SQL_SELECT + """,
pick AS (
  SELECT 'best_single' AS role, (SELECT system FROM single ORDER BY score DESC, position LIMIT 1) AS chosen
  UNION ALL SELECT 'teacher_primary', (SELECT system FROM single WHERE system IN ('m0', 'm1', 'm2') ORDER BY score DESC, system LIMIT 1)
  UNION ALL SELECT 'teacher_repro', (SELECT system FROM single WHERE system IN ('m2', 'm0') ORDER BY score DESC, system DESC LIMIT 1)
  UNION ALL SELECT 'ensemble', (SELECT concat(members, '|', rule) FROM scored WHERE rank = 1))
SELECT concat(role, '_three') AS name, 'three' AS task, role, chosen FROM pick""")
def selection_record(spark, sf):
    """Everything that is selected for the task, frozen in one record."""
    _, record = frozen_selections(spark, sf)
    return record.select("name", "task", "role", "chosen")


@query("alias_system", f"""WITH {SQL_PREDICTIONS},
every AS (SELECT system, seed, y, pred FROM preds UNION ALL SELECT 'distill4', seed, y, pred FROM preds WHERE system = 'm2'),
{_sql_metrics('every', 'system, seed')}
SELECT system, seed, n, round(macro_f1, 9) AS macro_f1 FROM runm""")
def alias_system(spark, sf):
    p = predictions(spark, sf)
    both = p.unionByName(E.alias_system(p, "m2", "distill4"))
    return _rounded(P.run_scores(both, RUN, N_CLASSES).select(*RUN, "n", "macro_f1"), "macro_f1")


# ------------------------------------------------------------------------------ statistics
PAIRS = [("m3", "m0"), ("m3", "m1"), ("m2", "m0"), ("m1", "m0")]
SQL_PAIRS = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") p(a, b))"
# For df = 2 Student's t has closed forms: p = 1 - |t| / sqrt(2 + t^2), t(0.975) below.
T975_DF2 = "(0.95::DOUBLE * sqrt(2.0::DOUBLE) / sqrt(1.0::DOUBLE - 0.95::DOUBLE * 0.95::DOUBLE))"
SQL_TTEST = SQL_TEST_M + f""", {SQL_PAIRS},
d AS (SELECT p.a, p.b, x.macro_f1 - y.macro_f1 AS d FROM pairs p JOIN runm x ON x.system = p.a
      JOIN runm y ON y.system = p.b AND y.seed = x.seed),
size AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM labels3),
tt AS (
  SELECT a, b, count(*) AS r, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
    avg(d) / sqrt((1.0::DOUBLE / count(*) + max(n_test)::DOUBLE / max(n_train)) * var_samp(d)) AS t, count(*) - 1 AS df
  FROM d, size GROUP BY a, b),
tp AS (SELECT *, 1 - abs(t) / sqrt(2 + t * t) AS p FROM tt)"""


def partition_sizes(spark, sf):
    """Sizes of the training and test partitions as scalar subqueries."""
    def size(split):
        return labels3(spark, sf).agg(F.count_if(F.col("split") == split).alias("n")).scalar()

    return size("train"), size("test")


def ttests(spark, sf):
    scores = test_scores(spark, sf).withColumn("task", F.lit("three"))
    pairs = spark.createDataFrame([("three", a, b) for a, b in PAIRS], "task string, a string, b string")
    n_train, n_test = partition_sizes(spark, sf)
    diffs = H.paired_differences(scores, pairs, "task", "system", ["seed"])
    diffs = diffs.withColumn("n_train", n_train).withColumn("n_test", n_test)
    return H.corrected_ttest(diffs, ["task", "a", "b"], F.col("n_train"), F.col("n_test"))


_TCOLS = ("mean_diff", "sd_diff", "t", "p")


@query("nb_ttest", SQL_TTEST + """
SELECT a, b, r, df, round(mean_diff, 9) AS mean_diff, round(sd_diff, 9) AS sd_diff, round(t, 6) AS t, round(p, 6) AS p FROM tp""")
def nb_ttest(spark, sf):
    t = ttests(spark, sf)
    return t.select("a", "b", "r", "df", *[F.round(c, 9).alias(c) for c in ("mean_diff", "sd_diff")],
                    *[F.round(c, 6).alias(c) for c in ("t", "p")])


@query("holm_adjust", SQL_TTEST + """,
k AS (SELECT a, b, p, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS m FROM tp)
SELECT x.a, x.b, round(max(least(1.0, (y.m - y.k + 1) * y.p)), 6) AS p_holm
FROM k x JOIN k y ON y.k <= x.k GROUP BY x.a, x.b""")
def holm_adjust(spark, sf):
    adjusted = H.holm(ttests(spark, sf), ["task"], "p", ["a", "b"])
    return adjusted.select("a", "b", F.round("p_holm", 6).alias("p_holm"))


SQL_MCNEMAR = f"""WITH {SQL_PREDICTIONS}, {SQL_PAIRS},
mc AS (
  SELECT x.seed, p.a, p.b AS b_system, count(*) AS n_items, 0::BIGINT AS n_unpaired,
    count(*) FILTER (WHERE x.pred = x.y AND y.pred <> y.y) AS b, count(*) FILTER (WHERE x.pred <> x.y AND y.pred = y.y) AS c
  FROM pairs p JOIN preds x ON x.system = p.a AND x.split = 'test'
  JOIN preds y ON y.system = p.b AND y.seed = x.seed AND y.uid = x.uid GROUP BY x.seed, p.a, p.b),
m2 AS (SELECT *, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact_binomial' ELSE 'chi2_cc' END AS method,
  CASE WHEN b + c >= 25 THEN power(abs(b - c) - 1, 2)::DOUBLE / (b + c) END AS chi2_cc FROM mc),
tail AS (
  SELECT seed, a, b_system,
    least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)))
      FROM (SELECT b + c AS n) z, unnest(range(0, least(b, c) + 1)) AS u(i))) AS exact_p,
    CASE WHEN chi2_cc > 0 THEN 1 - (SELECT sum(exp(-h + (2 * i + 1) * ln(sqrt(h)) - lgamma(i + 1.5)))
      FROM (SELECT chi2_cc / 2 AS h) z, unnest(range(0, 400)) AS u(i)) ELSE 1 END AS chi_p
  FROM m2)"""


@query("mcnemar", SQL_MCNEMAR + """
SELECT m2.seed, m2.a, m2.b_system, n_items, n_unpaired, b, c, method, round(chi2_cc, 9) AS chi2_cc,
  round(CASE method WHEN 'none' THEN 1 WHEN 'exact_binomial' THEN exact_p ELSE chi_p END, 6) AS p
FROM m2 JOIN tail t ON t.seed = m2.seed AND t.a = m2.a AND t.b_system = m2.b_system""")
def mcnemar(spark, sf):
    test = M.predicted(predictions(spark, sf).filter(F.col("split") == "test"))
    masks = H.correctness_masks(test, SYSTEMS, ["seed"])
    out = H.mcnemar(H.mcnemar_counts(masks, SYSTEMS, PAIRS, ["seed"]))
    return out.withColumn("chi2_cc", F.round("chi2_cc", 9)).withColumn("p", F.round("p", 6))


def _with_mcnemar(out, keys):
    """The p-values of single runs as columns."""
    def p_of(key):
        runs = F.filter("mcnemar", lambda m: _is_run(m, key))
        return F.round(F.get(F.transform(runs, lambda m: m["p"]), F.lit(0)), 6).alias("p_" + "_".join(map(str, key.values())))

    return out.withColumn("n_mcnemar", F.size("mcnemar")).select("*", *[p_of(k) for k in keys]).drop("mcnemar")


def _is_run(m, key):
    same = F.lit(True)
    for name, value in key.items():
        same = same & (m[name] == value)
    return same


SQL_HOLM = """
k AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS m FROM tp),
h AS (SELECT x.a, x.b, max(least(1.0, (y.m - y.k + 1) * y.p)) AS p_holm FROM k x JOIN k y ON y.k <= x.k GROUP BY x.a, x.b)"""


@query("paired_compare", SQL_TTEST + f""",
{SQL_HOLM}, {SQL_MCNEMAR.split(', ' + SQL_PAIRS + ',', 1)[1].strip()},
mp AS (SELECT m2.a, m2.b_system, """ + ", ".join(
    f"round(max(CASE method WHEN 'none' THEN 1 WHEN 'exact_binomial' THEN exact_p ELSE chi_p END) FILTER (WHERE m2.seed = {s}), 6) AS p_{s}"
    for s in SEEDS) + """
  FROM m2 JOIN tail t ON t.seed = m2.seed AND t.a = m2.a AND t.b_system = m2.b_system GROUP BY m2.a, m2.b_system)
SELECT tp.a, tp.b, r, df, round(mean_diff, 9) AS mean_diff, round(sd_diff, 9) AS sd_diff, round(t, 6) AS t, round(p, 6) AS p,
  round(p_holm, 6) AS p_holm, 3 AS n_mcnemar, p_42, p_43, p_44
FROM tp JOIN h ON tp.a = h.a AND tp.b = h.b JOIN mp ON mp.a = tp.a AND mp.b_system = tp.b""")
def paired_compare(spark, sf):
    test = predictions(spark, sf).filter(F.col("split") == "test")
    out = P.comparison_report(test, PAIRS, N_CLASSES, *partition_sizes(spark, sf))
    out = _with_mcnemar(out, [{"seed": s} for s in SEEDS])
    return _rounded(_rounded(out, "mean_diff", "sd_diff"), "t", "p", "p_holm", digits=6)


# The declared pairs name roles; who stands for them follows from the frozen record.
DECLARED = [("@ensemble", "@best_single"), ("@best_single", "m0"), ("m3", "@teacher_primary"), ("@teacher_repro", "@teacher_primary"),
            ("@nobody", "m1"), ("m2", "m1")]


@query("declared_comparisons", SQL_MATERIALISED + f""",
picks AS (
  SELECT '@best_single' AS ref, (SELECT system FROM single ORDER BY score DESC, position LIMIT 1) AS chosen
  UNION ALL SELECT '@teacher_primary', (SELECT system FROM single WHERE system IN ('m0', 'm1', 'm2') ORDER BY score DESC, system LIMIT 1)
  UNION ALL SELECT '@teacher_repro', (SELECT system FROM single WHERE system IN ('m2', 'm0') ORDER BY score DESC, system DESC LIMIT 1)
  UNION ALL SELECT '@ensemble', 'ens'),
declared AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in DECLARED)}) d(a, b)),
pairs AS (SELECT DISTINCT coalesce(x.chosen, d.a) AS a, coalesce(y.chosen, d.b) AS b FROM declared d LEFT JOIN picks x ON x.ref = d.a
  LEFT JOIN picks y ON y.ref = d.b WHERE coalesce(x.chosen, d.a) <> coalesce(y.chosen, d.b) AND coalesce(x.chosen, d.a) <> '@nobody'),
everyone AS (SELECT system, seed, y, pred FROM preds WHERE split = 'test' UNION ALL
  SELECT system, seed, y, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END FROM both_ens WHERE split = 'test'),
{_sql_metrics('everyone', 'system, seed', 'e')},
d AS (SELECT p.a, p.b, x.macro_f1 - y.macro_f1 AS d FROM pairs p JOIN erunm x ON x.system = p.a
      JOIN erunm y ON y.system = p.b AND y.seed = x.seed),
size AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM labels3),
tt AS (SELECT a, b, count(*) AS r, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
    avg(d) / sqrt((1.0::DOUBLE / count(*) + max(n_test)::DOUBLE / max(n_train)) * var_samp(d)) AS t, count(*) - 1 AS df
  FROM d, size GROUP BY a, b),
tp AS (SELECT *, 1 - abs(t) / sqrt(2 + t * t) AS p FROM tt), {SQL_HOLM}
SELECT tp.a, tp.b, r, df, round(mean_diff, 9) AS mean_diff, round(t, 6) AS t, round(p, 6) AS p, round(p_holm, 6) AS p_holm
FROM tp JOIN h ON tp.a = h.a AND tp.b = h.b""")
def declared_comparisons(spark, sf):
    """The comparisons of a task as they follow from its selections, the selected ensemble among the systems."""
    p = predictions(spark, sf)
    chosen, record = frozen_selections(spark, sf)
    weights = {r.system: r.score for r in P.single_scores(p, plan()).collect()}  # one row a candidate
    test = p.filter(F.col("split") == "test")
    ens = Sels.materialise(test, record, chosen, TASK, N_CLASSES, "ens", weights)
    names = record.withColumn("chosen", F.when(F.col("role") == "ensemble", "ens").otherwise(F.col("chosen")))
    declared = spark.createDataFrame([(TASK, a, b) for a, b in DECLARED], "task string, a string, b string")
    pairs = Sels.comparison_families(names, declared).orderBy("a", "b").collect()  # a report-sized list
    everyone = stage(test.unionByName(ens.drop("logits")), "systems")
    out = P.comparison_report(everyone, [(r.a, r.b) for r in pairs], N_CLASSES, *partition_sizes(spark, sf))
    out = out.select("a", "b", "r", "df", "mean_diff", "t", "p", "p_holm")
    return _rounded(_rounded(out, "mean_diff"), "t", "p", "p_holm", digits=6)


@query("t_ci", SQL_TEST_M + f"""
SELECT system, count(*) AS n_runs, round(avg(macro_f1), 9) AS macro_f1_mean,
  round(avg(macro_f1) - {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_lo,
  round(avg(macro_f1) + {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_hi
FROM runm GROUP BY system""")
def t_ci(spark, sf):
    out = H.t_interval(M.mean_sd(test_scores(spark, sf), ["system"], ["macro_f1"]), "macro_f1")
    return out.select(
        "system", "n_runs", F.round("macro_f1_mean", 9).alias("macro_f1_mean"),
        F.round("macro_f1_lo", 6).alias("macro_f1_lo"), F.round("macro_f1_hi", 6).alias("macro_f1_hi"),
    )




# Five folds and three seeds: t(0.975) for df = 14.
T975_DF14 = "2.1447866879169273::DOUBLE"
SQL_FOLDS_M = (f"WITH {SQL_PREDICTIONS}, "
               + _sql_metrics("(SELECT *, CAST(uid % 5 AS INTEGER) AS fold FROM preds WHERE " + TEST + ")", "system, seed, fold"))


def fold_predictions(spark, sf):
    """Test predictions of runs told apart by seed and fold: every text is tested in one fold."""
    test = predictions(spark, sf).filter(F.col("split") == "test")
    return test.withColumn("fold", (F.col("uid") % 5).cast("int"))


@query("fold_system_report", SQL_FOLDS_M + f"""
SELECT system, count(*) AS n_runs, """ + ", ".join(
    f"round(avg({c}), 9) AS {c}_mean, round(stddev_samp({c}), 9) AS {c}_sd" for c in FOUR) + f""",
  round(avg(macro_f1) - {T975_DF14} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_lo,
  round(avg(macro_f1) + {T975_DF14} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_hi
FROM runm GROUP BY system""")
def fold_system_report(spark, sf):
    out = P.system_report(fold_predictions(spark, sf), N_CLASSES, run=("seed", "fold"))
    out = _rounded(out, *[f"{c}_{s}" for c in FOUR for s in ("mean", "sd")])
    return _rounded(out, "macro_f1_lo", "macro_f1_hi", digits=6)


@query("fold_paired_keys", SQL_FOLDS_M + f""", {SQL_PAIRS}
SELECT p.a, p.b, x.seed, x.fold, round(x.macro_f1 - y.macro_f1, 9) AS diff FROM pairs p JOIN runm x ON x.system = p.a
JOIN runm y ON y.system = p.b AND y.seed = x.seed AND y.fold = x.fold""")
def fold_paired_keys(spark, sf):
    """Differences of macro-F1 between runs of the same seed and fold."""
    scores = P.run_scores(fold_predictions(spark, sf), ["system", "seed", "fold"], N_CLASSES).withColumn("task", F.lit("t"))
    pairs = spark.createDataFrame([("t", a, b) for a, b in PAIRS], "task string, a string, b string")
    out = H.paired_differences(scores, pairs, "task", "system", ["seed", "fold"])
    return out.select("a", "b", "seed", "fold", F.round(F.col("score_a") - F.col("score_b"), 9).alias("diff"))


# Student's t with an even number of degrees of freedom has a closed form (here 14): with s = t / sqrt(14 + t^2) and
# c = 14 / (14 + t^2), p = 1 - |s| (1 + c / 2 + 3 c^2 / 8 + ...), six powers of c.
_SERIES = " + ".join(f"{math.comb(2 * k, k) / 4**k!r}::DOUBLE * power(14 / (14 + t * t), {k})" for k in range(7))


@query("fold_comparisons", SQL_FOLDS_M + f""", {SQL_PAIRS},
d AS (SELECT p.a, p.b, x.macro_f1 - y.macro_f1 AS d FROM pairs p JOIN runm x ON x.system = p.a
  JOIN runm y ON y.system = p.b AND y.seed = x.seed AND y.fold = x.fold),
size AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM labels3),
tt AS (SELECT a, b, count(*) AS r, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff, count(*) - 1 AS df,
    avg(d) / sqrt((1.0::DOUBLE / count(*) + max(n_test)::DOUBLE / max(n_train)) * var_samp(d)) AS t FROM d, size GROUP BY a, b),
tp AS (SELECT *, 1 - abs(t) / sqrt(14 + t * t) * ({_SERIES}) AS p FROM tt), {SQL_HOLM}
SELECT tp.a, tp.b, r, df, round(mean_diff, 9) AS mean_diff, round(sd_diff, 9) AS sd_diff, round(t, 6) AS t, round(p, 6) AS p,
  round(p_holm, 6) AS p_holm, 15 AS n_mcnemar FROM tp JOIN h ON tp.a = h.a AND tp.b = h.b""")
def fold_comparisons(spark, sf):
    out = P.comparison_report(
        fold_predictions(spark, sf), PAIRS, N_CLASSES, *partition_sizes(spark, sf), run=("seed", "fold"))
    out = out.withColumn("n_mcnemar", F.size("mcnemar")).drop("mcnemar")
    return _rounded(_rounded(out, "mean_diff", "sd_diff"), "t", "p", "p_holm", digits=6)


@query("bootstrap_patterns", f"""WITH {SQL_PREDICTIONS},
item AS (SELECT system, uid, max(y) AS y, sum(pred * CASE seed WHEN 42 THEN 1 WHEN 43 THEN 3 ELSE 9 END)::BIGINT AS code
  FROM preds WHERE split = 'test' GROUP BY system, uid)
SELECT system, y::INTEGER AS y, code, true AS complete, count(*) AS n FROM item GROUP BY system, y, code""")
def bootstrap_patterns(spark, sf):
    test = M.predicted(predictions(spark, sf).filter(F.col("split") == "test"))
    return H.bootstrap_patterns(test, ["system"], "seed", SEEDS, N_CLASSES)


_CASES = " ".join(f"WHEN h < '{t:08x}' THEN {k}" for k, t in enumerate(H.poisson_steps()))
_F1 = " + ".join(
    f"CASE WHEN sum(n * ((y = {c})::INTEGER + (code // {3**r} % 3 = {c})::INTEGER)) > 0 THEN "
    f"2.0::DOUBLE * sum(n) FILTER (WHERE y = {c} AND code // {3**r} % 3 = {c}) "
    f"/ sum(n * ((y = {c})::INTEGER + (code // {3**r} % 3 = {c})::INTEGER)) ELSE 0 END" for r in range(3) for c in range(3))
_F1 = _F1.replace("sum(n) FILTER", "coalesce(sum(n) FILTER").replace(") / sum", "), 0) / sum")
SQL_BOOT = f"""
item AS (SELECT system, uid, max(y) AS y, sum(pred * CASE seed WHEN 42 THEN 1 WHEN 43 THEN 3 ELSE 9 END)::BIGINT AS code
  FROM preds WHERE split = 'test' GROUP BY system, uid),
hashed AS (SELECT system, y, code, k.k AS block, md5(concat('0:', k.k, ':', uid)) AS md FROM item, unnest(range(0, 500)) AS k(k)),
parts AS (SELECT system, y, code, block * 4 + p.p AS replicate, substr(md, 1 + 8 * p.p, 8) AS h FROM hashed, (VALUES (0), (1), (2), (3)) p(p)),
drawn AS (SELECT system, replicate, y, code, CASE {_CASES} ELSE {len(H.poisson_steps())} END AS n FROM parts),
boot AS (SELECT system, replicate, ({_F1}) / 9 AS value FROM drawn WHERE n > 0 GROUP BY system, replicate),
interval_of AS (SELECT system, quantile_cont(value, 0.025) AS boot_lo, quantile_cont(value, 0.975) AS boot_hi FROM boot GROUP BY system)"""


@query("boot_ci", f"WITH {SQL_PREDICTIONS}, {SQL_BOOT} SELECT system, round(boot_lo, 9) AS boot_lo, round(boot_hi, 9) AS boot_hi FROM interval_of")
def boot_ci(spark, sf):
    test = M.predicted(predictions(spark, sf).filter(F.col("split") == "test"))
    return _rounded(H.bootstrap_interval(test, ["system"], "seed", SEEDS, N_CLASSES), "boot_lo", "boot_hi")


SQL_REPORT = """
  SELECT system, count(*) AS n_runs, """ + ", ".join(
    f"round(avg({c}), 9) AS {c}_mean, round(stddev_samp({c}), 9) AS {c}_sd" for c in FOUR) + f""",
    round(avg(macro_f1) - {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_lo,
    round(avg(macro_f1) + {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_hi
  FROM runm GROUP BY system"""


@query("system_report", SQL_TEST_M + f""", {SQL_BOOT}, report AS ({SQL_REPORT})
SELECT report.*, round(boot_lo, 9) AS boot_lo, round(boot_hi, 9) AS boot_hi FROM report JOIN interval_of USING (system)""")
def system_report(spark, sf):
    """Everything a report says of a system, with both intervals."""
    out = P.system_report(predictions(spark, sf).filter(F.col("split") == "test"), N_CLASSES, seeds=SEEDS)
    out = _rounded(out, *[f"{c}_{s}" for c in FOUR for s in ("mean", "sd")], "boot_lo", "boot_hi")
    return _rounded(out, "macro_f1_lo", "macro_f1_hi", digits=6)


_TWO = _sql_metrics("two", "system, seed", "t").replace("(VALUES (0), (1), (2)) k(k)", "(VALUES (0), (1)) k(k)")


def _sql_campaign(task: str, runs: str) -> str:
    return f"""SELECT '{task}' AS task, system, count(*) AS n_runs, """ + ", ".join(
        f"round(avg({c}), 9) AS {c}_mean, round(stddev_samp({c}), 9) AS {c}_sd" for c in FOUR) + f""",
  round(avg(macro_f1) - {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_lo,
  round(avg(macro_f1) + {T975_DF2} * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS macro_f1_hi,
  (row_number() OVER (ORDER BY avg(macro_f1) DESC, system))::INTEGER AS place FROM {runs} GROUP BY system"""


@query("campaign_report", SQL_TEST_M.replace("SELECT * FROM preds WHERE", "SELECT concat('sys-', system) AS system, seed, y, pred FROM preds WHERE system <> 'm3' AND") + f""",
two AS (SELECT concat('sys-', system) AS system, seed, (y = 2)::INTEGER AS y, (p2 > p0 + p1)::INTEGER AS pred FROM preds
  WHERE split = 'test' AND system <> 'm3'),
{_TWO}
{_sql_campaign('three', 'runm')} UNION ALL {_sql_campaign('binary', 'trunm')}""")
def campaign_report(spark, sf):
    """Two tasks over the same texts in one report; systems are found by patterns of run ids, one system is not asked for."""
    p = predictions(spark, sf).filter(F.col("split") == "test").withColumn("run_id", F.concat("system", F.lit("__s"), "seed"))
    two = p.withColumn("y", (F.col("y") == 2).cast("int")).withColumn("probs", F.array(
        F.get("probs", F.lit(0)) + F.get("probs", F.lit(1)), F.get("probs", F.lit(2))))
    both = p.withColumn("task", F.lit("three")).unionByName(two.withColumn("task", F.lit("binary")))
    out = P.campaign_report(both.drop("system"), {"three": 3, "binary": 2}, {f"sys-m{k}": f"m{k}__s.*" for k in range(3)})
    out = _rounded(out, *[f"{c}_{s}" for c in FOUR for s in ("mean", "sd")])
    return _rounded(out, "macro_f1_lo", "macro_f1_hi", digits=6)


# A hundred systems of varying quality, compared with their neighbours.
MANY = 100
MANY_PAIRS = [(f"s{k}", f"s{(k + 1) % MANY}") for k in range(MANY)]


@query("mcnemar_many", f"""WITH {SQL_LABELS3},
p AS (SELECT k, doc_id, y, CASE WHEN (doc_id * 31 + k * 17) % 101 < 40 + k % 50 THEN y ELSE (y + 1) % 3 END AS pred
  FROM labels3, unnest(range(0, {MANY})) AS s(k) WHERE (doc_id + k) % 13 <> 0)
SELECT concat('s', a.k) AS a, concat('s', (a.k + 1) % {MANY}) AS b_system,
  count(*) FILTER (WHERE a.pred IS NOT NULL AND b.pred IS NOT NULL) AS n_items,
  count(*) FILTER (WHERE a.pred IS NULL OR b.pred IS NULL) AS n_unpaired,
  count(*) FILTER (WHERE a.pred = a.y AND b.pred <> b.y) AS b, count(*) FILTER (WHERE a.pred <> a.y AND b.pred = b.y) AS c
FROM (SELECT k.k, doc_id, pred, p.y FROM (SELECT unnest(range(0, {MANY})) AS k) k CROSS JOIN labels3 LEFT JOIN p USING (k, doc_id)) a
JOIN (SELECT k.k, doc_id, pred, p.y FROM (SELECT unnest(range(0, {MANY})) AS k) k CROSS JOIN labels3 LEFT JOIN p USING (k, doc_id)) b
  ON b.k = (a.k + 1) % {MANY} AND a.doc_id = b.doc_id
WHERE a.pred IS NOT NULL OR b.pred IS NOT NULL GROUP BY a.k""")
def mcnemar_many(spark, sf):
    """Paired counts among a hundred systems that do not all predict every item, from one pass."""
    rows = labels3(spark, sf).select("doc_id", "y", F.explode(F.sequence(F.lit(0), F.lit(MANY - 1))).alias("k"))
    rows = rows.filter((F.col("doc_id") + F.col("k")) % 13 != 0)
    good = (F.col("doc_id") * 31 + F.col("k") * 17) % 101 < 40 + F.col("k") % 50
    p = rows.select(F.concat(F.lit("s"), "k").alias("system"), F.lit(1).alias("seed"), F.col("doc_id").alias("uid"), "y",
                    F.when(good, F.col("y")).otherwise((F.col("y") + 1) % 3).alias("pred"))
    names = [f"s{k}" for k in range(MANY)]
    return H.mcnemar_counts(H.correctness_masks(p, names, ["seed"]), names, MANY_PAIRS, ["seed"]).drop("seed")


# -------------------------------------------------------------------------- early stopping
@query("early_stop", """
WITH RECURSIVE h AS (
  SELECT conv_id, turn, (length(text) % 97) / 97.0::DOUBLE AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
walk AS (
  SELECT conv_id, i, turn AS best_epoch, s AS best_score, 0 AS bad FROM h WHERE i = 1
  UNION ALL
  SELECT h.conv_id, h.i, CASE WHEN h.s > w.best_score THEN h.turn ELSE w.best_epoch END,
    greatest(h.s, w.best_score), CASE WHEN h.s > w.best_score THEN 0 ELSE w.bad + 1 END
  FROM walk w JOIN h ON h.conv_id = w.conv_id AND h.i = w.i + 1 WHERE w.bad < 2),
fin AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM walk)
SELECT f.conv_id, best_epoch, round(best_score, 9) AS best_score, f.i::INTEGER AS epochs_run,
  f.i < (SELECT count(*) FROM h WHERE h.conv_id = f.conv_id) AS stopped_early
FROM fin f WHERE k = 1""")
def early_stop(spark, sf):
    """Each conversation is a training run, its turns the epochs, a length hash the score."""
    h = table(spark, sf, "conversations").select(
        "conv_id", "turn", ((F.length("text") % 97) / F.lit(97.0)).alias("score")
    )
    return _rounded(Sel.early_stop(h, ["conv_id"], "turn", "score", 2), "best_score")
