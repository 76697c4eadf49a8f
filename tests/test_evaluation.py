"""Metrics, ensembles, selection and statistics: edge cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions import arrays as A
from labelloom.functions import numeric
from labelloom.operators import ensemble, integrity, metrics, selection, stats
from labelloom.plans import evaluation as P


def test_argmax_softmax_and_losses(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 0.0, -1000.0], 0)], "z array<double>, y int")
    rows = df.select(
        A.argmax("z").alias("a"), A.softmax("z").alias("p"), A.cross_entropy("z", "y").alias("ce"),
        A.distillation_loss("z", "z", "y", 4.0, 0.5).alias("d"), A.log_probs(A.softmax("z")).alias("lp"),
    ).collect()
    assert [r.a for r in rows] == [1, 0]
    e = np.exp([1.0, 3.0, 3.0])
    assert rows[0].p == pytest.approx(list(e / e.sum()))
    assert rows[0].ce == pytest.approx(-math.log(e[1] / e.sum()))
    assert rows[0].d == pytest.approx(0.5 * rows[0].ce)          # KL of a model with itself is 0
    assert rows[1].p == pytest.approx([1.0, 0.0, 0.0]) and rows[1].lp[2] == pytest.approx(math.log(1e-12))


def predictions(spark, n=60, systems=("a", "b", "c"), seeds=(1, 2), splits=("val", "test"), seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y, split = rng.randint(0, 2), splits[i % len(splits)]
        for s in systems:
            for sd in seeds:
                w = [rng.random() + (0.6 if c == y else 0) for c in range(3)]
                rows.append((s, sd, split, f"u{i}", y, [x / sum(w) for x in w]))
    return spark.createDataFrame(rows, "system string, seed int, split string, uid string, y int, probs array<double>")


def macro(y, p, n_classes):
    out = []
    for c in range(n_classes):
        tp = sum(a == b == c for a, b in zip(y, p))
        both = sum(a == c for a in y) + sum(b == c for b in p)
        out.append(2 * tp / both if tp else 0.0)
    return sum(out) / n_classes


def test_metrics_with_an_absent_class(spark):
    df = spark.createDataFrame([("r", 0, 0), ("r", 0, 1), ("r", 1, 1)], "run string, y int, pred int")
    cells = metrics.confusion_cells(df, ["run"])
    per = metrics.per_class(cells, ["run"], 3).orderBy("cls").collect()
    assert [(r.precision, r.recall, r.support) for r in per] == [(1.0, 0.5, 2), (0.5, 1.0, 1), (0.0, 0.0, 0)]
    m = metrics.run_metrics(cells, ["run"], 3).first()
    assert m.accuracy == pytest.approx(2 / 3) and m.macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 3)
    assert metrics.confusion_matrix(cells, ["run"], 3).count() == 9


def test_single_run_has_no_spread(spark):
    df = spark.createDataFrame([("s", 0.5)], "system string, macro_f1 double")
    r = stats.t_interval(metrics.mean_sd(df, ["system"], ["macro_f1"]), "macro_f1").first()
    assert (r.macro_f1_sd, r.macro_f1_lo, r.macro_f1_hi) == (0.0, 0.5, 0.5)


def test_missing_run_stops_the_selection(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.6), ("b", 0.5)], "system string, macro_f1 double")
    with pytest.raises(Exception, match="lacks a finished run"):
        metrics.mean_score(df, ["system"], 2).collect()


@pytest.mark.parametrize("rule", ensemble.RULES)
def test_ensemble_rules_match_brute_force(spark, rule):
    p = predictions(spark)
    w = {"a": 0.9, "b": 0.5, "c": 0.4}
    got = ensemble.combine(p, ["a", "b", "c"], rule, 3, ["seed"], w).collect()
    rows = {}
    for r in p.collect():
        rows.setdefault((r.seed, r.uid), {})[r.system] = np.array(r.probs)
    for g in got:
        m = rows[(g.seed, g.uid)]
        uniform = sum(m.values()) / 3
        if rule == "uniform_prob_mean":
            want = uniform
        elif rule == "valf1_weighted_prob_mean":
            want = sum(w[s] * m[s] for s in m) / sum(w.values())
        else:
            votes = np.bincount([int(v.argmax()) for v in m.values()], minlength=3)
            want = uniform if (votes == votes.max()).sum() > 1 else votes / 3
        assert g.probs == pytest.approx(list(want), abs=1e-11)


def plan(exhaustive):
    return P.EnsemblePlan(("a", "b", "c", "d"), 3, (1, 2), size=2, exhaustive=exhaustive)


@pytest.mark.parametrize("exhaustive", [True, False])
def test_selection_never_looks_at_test_rows(spark, exhaustive):
    p = predictions(spark, systems=("a", "b", "c", "d"))
    chosen = P.select_ensemble(p, plan(exhaustive)).orderBy("rank").collect()
    permuted = p.withColumn("y", F.when(F.col("split") == "test", 2 - F.col("y")).otherwise(F.col("y")))
    assert P.select_ensemble(permuted, plan(exhaustive)).orderBy("rank").collect() == chosen
    hidden = p.filter("split = 'val'")
    assert P.select_ensemble(hidden, plan(exhaustive)).orderBy("rank").collect() == chosen


def test_candidate_scores_match_brute_force(spark):
    p = predictions(spark, systems=("a", "b", "c", "d"))
    got = {(r.members, r.rule): r.mean_val_macro_f1 for r in P.select_ensemble(p, plan(True)).collect()}
    assert len(got) == 6 * 3
    for (members, rule), score in got.items():
        if rule == "valf1_weighted_prob_mean":
            continue
        c = ensemble.combine(p.filter("split = 'val'"), members.split("+"), rule, 3, ["seed"]).collect()
        per = [macro([r.y for r in c if r.seed == s], [int(np.argmax(r.probs)) for r in c if r.seed == s], 3) for s in (1, 2)]
        assert score == pytest.approx(sum(per) / 2, abs=1e-9)


def test_equal_scores_keep_listing_order(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 0.7)], "system string, score double")
    assert selection.best(selection.listed(df, "system", ["x", "z", "y"]), []).first().system == "z"


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "sel")
    first = spark.createDataFrame([("best", "m1", "h")], "name string, chosen string, inputs_sha256 string")
    assert selection.write_once(first, path).count() == 1
    assert selection.write_once(first, path).count() == 1
    with pytest.raises(RuntimeError, match="choice changed"):
        selection.write_once(first.withColumn("chosen", F.lit("m2")), path)
    with pytest.raises(RuntimeError, match="inputs changed"):
        selection.write_once(first.withColumn("inputs_sha256", F.lit("g")), path)


def test_freeze_statuses(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, digest string")
    n = spark.createDataFrame([("a", "1"), ("b", "9")], "name string, digest string")
    got = {r.name: r.status for r in integrity.freeze_check(f, n, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing", "d": "unfrozen"}
    integrity.assert_frozen(f, f, ["a", "b", "c"])
    with pytest.raises(RuntimeError, match="b=changed, c=missing, d=unfrozen"):
        integrity.assert_frozen(f, n, ["a", "b", "c", "d"])


def early(history, patience):
    best, best_epoch, bad, run = -math.inf, None, 0, 0
    for e, s in enumerate(history, 1):
        run = e
        if s > best:
            best, best_epoch, bad = s, e, 0
        else:
            bad += 1
            if patience and bad >= patience:
                break
    return best_epoch, run


@pytest.mark.parametrize("patience", [0, 1, 3])
def test_early_stop_matches_the_loop(spark, patience):
    rng = random.Random(4)
    runs = {i: [rng.randint(0, 6) / 6 for _ in range(rng.randint(1, 12))] for i in range(80)}
    rows = [(i, e, s) for i, h in runs.items() for e, s in enumerate(h, 1)]
    df = spark.createDataFrame(rows, "run int, epoch int, f double")
    for r in selection.early_stop(df, ["run"], "epoch", "f", patience).collect():
        assert (r.best_epoch, r.epochs_run) == early(runs[r.run], patience)
        assert r.stopped_early == (r.epochs_run < len(runs[r.run]))


# ----------------------------------------------------------------------------- statistics
def test_tails_against_closed_forms():
    for t in (0.0, 0.3, 1.0, 2.5, 12.0):
        assert numeric.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert numeric.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    # printed tables: 4 and 30 degrees of freedom
    assert numeric.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-6)
    assert numeric.t_quantile(0.975, 30) == pytest.approx(2.042272, abs=1e-6)


def test_holm_with_nulls_and_ties(spark):
    rows = [("f", 0, 0.01), ("f", 1, None), ("f", 2, 0.04), ("f", 3, 0.01), ("f", 4, 0.9), ("g", 0, 0.6)]
    df = spark.createDataFrame(rows, "fam string, i int, p double")
    got = {(r.fam, r.i): r.p_holm for r in stats.holm(df, ["fam"], "p", ["i"]).collect()}
    assert got[("f", 1)] is None
    assert [got[("f", i)] for i in (0, 3, 2, 4)] == pytest.approx([0.04, 0.04, 0.08, 0.9])
    assert got[("g", 0)] == pytest.approx(0.6)


def test_corrected_t_edge_cases(spark):
    rows = [("one", 0.5, 0.4), ("same", 0.5, 0.5), ("same", 0.6, 0.6), ("const", 0.75, 0.5), ("const", 0.5, 0.25),
            ("vary", 0.6, 0.5), ("vary", 0.7, 0.4), ("vary", 0.5, 0.45)]
    df = spark.createDataFrame(rows, "c string, score_a double, score_b double")
    got = {r.c: r for r in stats.corrected_ttest(df, ["c"], F.lit(80), F.lit(10)).collect()}
    assert got["one"].t is None and got["one"].p is None and got["one"].r == 1
    assert (got["same"].t, got["same"].p) == (0.0, 1.0)
    assert got["const"].t == math.inf and got["const"].p == 0.0
    d = np.array([0.1, 0.3, 0.05])
    t = d.mean() / math.sqrt((1 / 3 + 10 / 80) * d.var(ddof=1))
    assert got["vary"].t == pytest.approx(t) and got["vary"].p == pytest.approx(1 - t / math.sqrt(2 + t * t))


def test_mcnemar_boundaries(spark):
    rows = [(0, 0, 0), (12, 12, 0), (2, 22, 0), (13, 12, 0), (30, 5, 0), (3, 4, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b long, c long, n_unpaired long")
    got = stats.mcnemar(df).orderBy("i").collect()
    assert [r.method for r in got] == ["none", "exact_binomial", "exact_binomial", "chi2_cc", "chi2_cc", None]

    def exact(b, c):
        return min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))

    assert [got[i].p for i in (0, 1, 2)] == pytest.approx([1.0, exact(12, 12), exact(2, 22)])
    assert got[3].chi2_cc == 0.0 and got[3].p == pytest.approx(1.0)
    assert got[4].p == pytest.approx(math.erfc(math.sqrt((24**2 / 35) / 2)))
    assert got[5].p is None


def test_mcnemar_counts_match_brute_force(spark):
    p = metrics.predicted(predictions(spark, n=80, splits=("test",)))
    masks = stats.correctness_masks(p, ["a", "b", "c"], ["seed"])
    got = {(r.seed, r.a, r.b_system): (r.b, r.c, r.n_items) for r in
           stats.mcnemar_counts(masks, ["a", "b", "c"], [("a", "b"), ("c", "a")], ["seed"]).collect()}
    right = {(r.system, r.seed, r.uid): r.pred == r.y for r in p.collect()}
    for (sd, a, b), (nb, nc, n) in got.items():
        pairs = [(right[(a, sd, f"u{i}")], right[(b, sd, f"u{i}")]) for i in range(80)]
        assert (nb, nc, n) == (sum(x and not y for x, y in pairs), sum(y and not x for x, y in pairs), 80)


def test_bootstrap_agrees_with_resampling_items(spark):
    p = metrics.predicted(predictions(spark, n=150, systems=("a",), splits=("test",)))
    patterns = stats.bootstrap_patterns(p, ["system"], "seed", [1, 2], 3)
    assert patterns.agg(F.sum("n")).first()[0] == 150
    got = stats.bootstrap_interval(p, ["system"], "seed", [1, 2], 3, replicates=2000).first()
    again = stats.bootstrap_interval(p.repartition(5), ["system"], "seed", [1, 2], 3, replicates=2000).first()
    assert got == again
    rows = {}
    for r in p.collect():
        rows.setdefault(r.uid, [r.y, {}])[1][r.seed] = r.pred
    y = np.array([v[0] for v in rows.values()])
    preds = [np.array([v[1][s] for v in rows.values()]) for s in (1, 2)]
    rng, vals = np.random.default_rng(1), []
    for _ in range(1500):
        i = rng.integers(0, len(y), len(y))
        vals.append(np.mean([macro(y[i].tolist(), q[i].tolist(), 3) for q in preds]))
    assert got.boot_lo == pytest.approx(np.quantile(vals, 0.025), abs=0.012)
    assert got.boot_hi == pytest.approx(np.quantile(vals, 0.975), abs=0.012)


def test_bootstrap_needs_the_same_items_in_every_run(spark):
    p = metrics.predicted(predictions(spark, n=20, systems=("a",), splits=("test",)))
    p = p.filter("not (seed = 2 and uid = 'u3')")
    r = stats.bootstrap_interval(p, ["system"], "seed", [1, 2], 3, replicates=100).first()
    assert r.boot_lo is None and r.boot_hi is None


def test_bootstrap_hashes_an_item_once_in_every_task(spark):
    """Items are dealt by cores, however few bytes they are, and hashed once for all systems; a null id is drawn as before."""
    p = metrics.predicted(predictions(spark, n=30, systems=("a", "b"), splits=("test",)))
    out = stats.bootstrap_interval(p, ["system"], "seed", [1, 2], 3, replicates=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "_held" in plan
    alone = [stats.bootstrap_interval(p.filter(F.col("system") == s), ["system"], "seed", [1, 2], 3, replicates=40).first() for s in "ab"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, alone))


def test_digest_frames_values_so_that_borders_cannot_move(spark):
    from labelloom.operators.integrity import content_digest
    a = spark.createDataFrame([("x\x1fvy", "z")], "a string, b string")
    b = spark.createDataFrame([("x", "y\x1fvz")], "a string, b string")
    c = spark.createDataFrame([("x,1:y", "z")], "a string, b string")
    d = spark.createDataFrame([("x", None)], "a string, b string")
    assert len({content_digest(t, ["a", "b"]).first().fp_sum for t in (a, b, c, d)}) == 4


def test_tokens_lose_all_white_space_and_occurrences_need_no_class_zero(spark):
    from labelloom.operators.attribution import global_importance, occurrences
    rows = [("u", 0, "\thello\n", 1, 2.0), ("u", 1, "hello\xa0", 1, 4.0), ("u", 1, "hello\xa0", 2, -1.0),
            ("v", 0, "\u2003", 1, 9.0), ("v", 1, "hello", 2, 0.5)]
    listed = spark.createDataFrame(rows, "uid string, pos int, token string, cls int, value double")
    got = global_importance(occurrences(listed, (0, 1, 2))).collect()
    assert [(r.token, r["count"], r.mean_abs) for r in got] == [("hello", 3, 2.5)]


def test_folds_of_an_empty_table_list_every_zero(spark):
    from labelloom.operators.integrity import VIEWS, leakage_by_fold
    df = spark.createDataFrame([], "parts array<string>, keys array<struct<view:string,key:binary>>")
    rows = leakage_by_fold(df, F.col("keys"), "parts", 2).collect()
    assert len(rows) == len(VIEWS) * 3 * 2 and all(r.n_shared == 0 for r in rows)


def test_runs_of_folds_are_not_pooled(spark):
    from labelloom.plans import evaluation as P
    rows = [("a", s, f, f"u{i}", i % 2, [0.4, 0.6] if (i * 7 + s + f) % 3 else [0.6, 0.4])
            for s in (1, 2) for f in range(5) for i in range(f, 50, 5)]
    p = spark.createDataFrame(rows, "system string, seed int, fold int, uid string, y int, probs array<double>")
    report = P.system_report(p, 2, run=("seed", "fold")).first()
    each = P.run_scores(p, ["seed", "fold"], 2).agg(F.avg("macro_f1")).first()[0]
    assert report.n_runs == 10 and abs(report.macro_f1_mean - each) < 1e-12


def test_poisson_steps_are_its_distribution():
    steps = stats.poisson_steps()
    u = np.random.default_rng(0).integers(0, 2**32, 200_000)
    n = (u[:, None] >= np.array(steps)[None, :]).sum(axis=1)
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02)
    assert steps == sorted(set(steps)) and steps[0] == math.floor(math.exp(-1) * 2**32)


def test_sets_of_more_than_sixty_names(spark):
    """A hundred partitions and seventy members: every pair and every gap is seen."""
    from labelloom.operators.integrity import alignment_check, leakage_matrix
    parts = [f"p{i}" for i in range(100)]
    rows = [(f"p{i}", [("v", bytes([k]))]) for k, own in enumerate([(0, 99), (61, 62, 63), (59, 60), (5,), (7, 7)]) for i in own]
    df = spark.createDataFrame([*rows, ("other", [("v", b"x")])], "part string, keys array<struct<view:string,key:binary>>")
    got = {(r.view, r.pair): r.n_shared for r in leakage_matrix(df, F.col("keys"), "part", parts, ("v", "w")).collect()}
    assert len(got) == 2 * 4950
    assert {k[1] for k, n in got.items() if n} == {"p0&p99", "p61&p62", "p61&p63", "p62&p63", "p59&p60"} and sum(got.values()) == 5
    members = [f"m{i}" for i in range(70)]
    rows = [(m, 1, u, 0, [0.5, 0.5]) for m in members for u in ("a", "b") if not (m == "m69" and u == "b")]
    p = spark.createDataFrame(rows, "system string, seed int, uid string, y int, probs array<double>")
    r = alignment_check(p, members, "system", ["seed"], "uid", "y", 2).first()
    assert (r.n_keys, r.misaligned) == (2, 1)
