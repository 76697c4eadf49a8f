"""Uncertainty and paired significance over runs.

Only confusion cells, run scores and packed correctness masks reach these functions; the
prediction rows themselves are aggregated once, map-side combined, per question.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import bits
from labelloom.functions.numeric import chi2_pvalue_1df, t_critical, t_pvalue

EXACT_BELOW = 25  # fixed value: discordant pairs below this get the exact binomial test
#: Tasks among which the items of a bootstrap are dealt, for each core of the session.
TASKS_A_CORE = 3


# ------------------------------------------------------------------- intervals over runs
def t_interval(summary: DataFrame, score: str, level: float = 0.95) -> DataFrame:
    """Add ``<score>_lo`` / ``<score>_hi`` to a mean / SD table; one run collapses to the mean."""
    n, mean, sd = F.col("n_runs"), F.col(f"{score}_mean"), F.col(f"{score}_sd")
    half = F.when(n < 2, F.lit(0.0)).otherwise(
        t_critical(level, n - 1) * sd / F.sqrt(n.cast("double"))
    )
    return summary.withColumn("_half", half).select(
        *summary.columns,
        (mean - F.col("_half")).alias(f"{score}_lo"),
        (mean + F.col("_half")).alias(f"{score}_hi"),
    )


# ------------------------------------------------------------------------------ bootstrap
def item_codes(
    predictions: DataFrame, by: Sequence[str], run: str, runs: Sequence, n_classes: int, uid: str = "uid",
) -> DataFrame:
    """``(by, uid, y, code, complete)``: every item with the predictions of all runs packed in base ``n_classes``.

    ``complete`` tells whether the item was predicted by every run exactly once.
    """
    if n_classes ** len(runs) >= 1 << 62:
        raise ValueError("too many runs or classes to pack into one code")
    weight = F.lit(0).cast("long")
    for i, r in enumerate(runs):
        weight = F.when(F.col(run) == r, F.lit(n_classes**i).cast("long")).otherwise(weight)
    size = len(runs)
    number = F.lit(-1)
    for i, r in enumerate(runs):
        number = F.when(F.col(run) == r, F.lit(i)).otherwise(number)
    seen = bits.names("_s", size)
    whole = F.col("k") == size
    for w, n in enumerate(seen):
        whole = whole & (F.col(n) == (1 << min(bits.WIDTH, size - w * bits.WIDTH)) - 1)
    per_item = (
        predictions.filter(F.col(run).isin(*runs))
        .select(*by, uid, F.col("y").cast("int").alias("y"), (weight * F.col("pred")).alias("c"),
                *[w.alias(n) for w, n in zip(bits.words(number, size), seen, strict=True)])
        .groupBy(*by, uid)
        .agg(F.max("y").alias("y"), F.sum("c").alias("code"), F.count(F.lit(1)).alias("k"),
             *[F.bit_or(n).alias(n) for n in seen])
    )
    return per_item.select(*by, uid, "y", "code", whole.alias("complete"))


def bootstrap_patterns(
    predictions: DataFrame, by: Sequence[str], run: str, runs: Sequence, n_classes: int,
    uid: str = "uid",
) -> DataFrame:
    """``(by, y, code, complete, n)``: items with the same truth and the same predictions in every run are exchangeable."""
    items = item_codes(predictions, by, run, runs, n_classes, uid)
    return items.groupBy(*by, "y", "code", "complete").agg(F.count(F.lit(1)).alias("n"))


def poisson_steps() -> list[int]:
    """How far the values 0, 1, 2, ... of a Poisson variable with mean 1 reach in 2**32 equal parts."""
    term = total = math.exp(-1)
    steps: list[int] = []
    while (reach := math.floor(total * 2**32)) < 2**32 - 1:
        steps.append(reach)
        term /= len(steps)
        total += term
    return steps


def bootstrap_interval(
    predictions: DataFrame, by: Sequence[str], run: str, runs: Sequence, n_classes: int,
    replicates: int = 2000, level: float = 0.95, seed: int = 0, uid: str = "uid",
) -> DataFrame:
    """Percentile interval of the run-averaged macro-F1, items resampled jointly for all runs.

    How often an item is drawn in a replicate is a Poisson variable with mean 1 that is read off
    md5(seed, replicate, item), four replicates a hash.  So every task resamples the items it holds, alike on every engine and in
    every run; an item is hashed once for all groups that hold it, and what is shuffled are counts of (replicate, truth, predictions).
    Items are dealt by ``TASKS_A_CORE`` tasks a core: they are few bytes and much work, so their size must not decide.  The number of items drawn
    varies by its square root, which the mean over them does not feel.
    Groups whose runs cover different items get nulls.
    """
    items = item_codes(predictions, by, run, runs, n_classes, uid)
    groups = items.groupBy(*by).agg(F.min("complete").alias("complete"))
    steps = poisson_steps()
    # An item's row lists the groups that hold it, one entry each.
    tasks = TASKS_A_CORE * predictions.sparkSession.sparkContext.defaultParallelism
    held = items.select(F.col(uid).alias("_uid"), F.struct(*by, "y", "code").alias("_e")).repartition(tasks, "_uid")
    held = held.groupBy("_uid").agg(F.collect_list("_e").alias("_held"))
    blocks = held.select("_held", "_uid", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))).alias("_block"))
    key = F.concat(F.lit(f"{seed}:"), F.col("_block").cast("string"), F.lit(":"), F.col("_uid").cast("string"))
    hashed = blocks.select("_held", "_block", F.md5(key).alias("_h"))
    drawn = hashed.select("_held", F.inline(F.array(*[
        F.struct((F.col("_block") * 4 + part).alias("replicate"), F.substring("_h", 1 + 8 * part, 8).alias("_d")) for part in range(4)])))
    # Digits of fixed width, so hexadecimal order is numeric order; below the first step nothing is drawn.
    drawn = drawn.filter(F.coalesce(F.col("_d") >= f"{steps[0]:08x}", F.lit(True)) & (F.col("replicate") < replicates))
    n = F.lit(len(steps))
    for k in range(len(steps) - 1, 0, -1):
        n = F.when(F.col("_d") < f"{steps[k]:08x}", k).otherwise(n)
    counts = drawn.select("_held", "replicate", n.alias("n")).select("replicate", "n", F.inline("_held"))
    counts = counts.groupBy(*by, "replicate", "y", "code").agg(F.sum("n").alias("n"))

    def pred(r: int) -> Column:
        return F.pmod(F.floor(F.col("code") / F.lit(n_classes**r)), F.lit(n_classes)) if r else F.pmod("code", F.lit(n_classes))

    def f1(r: int, c: int) -> Column:
        hit = F.sum(F.when((F.col("y") == c) & (pred(r) == c), F.col("n")).otherwise(0))
        both = F.sum(F.col("n") * ((F.col("y") == c).cast("int") + (pred(r) == c).cast("int")))
        return F.when(both > 0, 2.0 * hit / both).otherwise(0.0)

    scores = [f1(r, c) for r in range(len(runs)) for c in range(n_classes)]
    value = sum(scores[1:], scores[0]) / float(len(scores))
    values = counts.groupBy(*by, "replicate").agg(value.alias("value"))
    tail = (1.0 - level) / 2.0
    ci = values.groupBy(*by).agg(F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
    same = [groups[c].eqNullSafe(ci[c]) for c in by]
    q = F.when(F.col("complete"), F.col("q"))
    return groups.join(ci, same, "left").select(
        *[groups[c] for c in by], F.get(q, F.lit(0)).alias("boot_lo"), F.get(q, F.lit(1)).alias("boot_hi")
    )


# ----------------------------------------------------------------------------- paired tests
def paired_differences(
    scores: DataFrame, comparisons: DataFrame, task: str, system: str, pair: Sequence[str],
    score: str = "macro_f1",
) -> DataFrame:
    """``comparisons`` (task, a, b) x runs of both systems that share the pairing key."""
    a = scores.select(task, F.col(system).alias("a"), *pair, F.col(score).alias("score_a"))
    b = scores.select(task, F.col(system).alias("b"), *pair, F.col(score).alias("score_b"))
    return comparisons.join(a, [task, "a"]).join(b, [task, "b", *pair])


def corrected_ttest(diffs: DataFrame, by: Sequence[str], n_train: Column, n_test: Column) -> DataFrame:
    """Corrected resampled t test: t = mean(d) / sqrt((1/r + n_test/n_train) var(d)), df r - 1.

    Fewer than two pairs give nulls; zero variance gives t = 0, p = 1 or t = inf, p = 0.
    """
    d = F.col("score_a") - F.col("score_b")
    ratio = n_test.cast("double") / n_train.cast("double")
    base = diffs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("r"),
        F.avg(d).alias("mean_diff"),
        F.var_samp(d).alias("_var"),
        F.max(ratio).alias("_ratio"),
    )
    denom = F.sqrt((F.lit(1.0) / F.col("r") + F.col("_ratio")) * F.col("_var"))
    t = (
        F.when(F.col("r") < 2, F.lit(None).cast("double"))
        .when(denom > 0, F.col("mean_diff") / denom)
        .when(F.col("mean_diff") != 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    df = F.when(F.col("r") >= 2, F.col("r") - 1)
    stat = base.select(*by, "r", "mean_diff", F.sqrt("_var").alias("sd_diff"), t.alias("t"), df.alias("df"))
    return stat.withColumn("p", t_pvalue(F.col("t"), F.col("df")))


def holm(tests: DataFrame, family: Sequence[str], p: str, order: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Holm step-down within each family: (m - k) p of the k-th smallest p, capped at 1 and made
    monotone.  Null p-values stay null and do not count.  A family is a report-sized list."""
    known = F.col(p).isNotNull()
    by = [*family, known]
    ranked = Window.partitionBy(*by).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * F.col(p))
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tests.withColumn("_step", F.when(known, step))
        .withColumn(out, F.max("_step").over(running))
        .drop("_step")
    )


def correctness_masks(
    predictions: DataFrame, systems: Sequence[str], run: Sequence[str], uid: str = "uid",
    system: str = "system",
) -> DataFrame:
    """Distinct sets of (who predicted, who was right) per run, with their number of items.

    One pass serves every comparison between the listed systems, any number of them, and no system is ever joined
    with another."""
    size = len(systems)
    number, right = bits.place(F.col(system), systems), F.col("pred") == F.col("y")
    columns = dict(zip(bits.names("seen", size), bits.words(number, size), strict=True)) | dict(
        zip(bits.names("right", size), bits.words(number, size, right), strict=True))
    return (
        predictions.filter(F.col(system).isin(*systems))
        .select(*run, uid, *[c.alias(n) for n, c in columns.items()])
        .groupBy(*run, uid)
        .agg(*[F.bit_or(n).alias(n) for n in columns])
        .groupBy(*run, *columns)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mcnemar_counts(masks: DataFrame, systems: Sequence[str], pairs: Sequence[tuple[str, str]],
                   run: Sequence[str]) -> DataFrame:
    """Per run and pair: b (only a right), c (only b right), items seen by one system only."""
    at = {s: i for i, s in enumerate(systems)}
    who, good = bits.members("seen", len(systems)), bits.members("right", len(systems))
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b_system"), F.lit(at[a]).alias("i"), F.lit(at[b]).alias("j"))
                       for a, b in pairs])
    each = masks.select(*run, "n", who.alias("_who"), good.alias("_good")).select(*run, "n", "_who", "_good", F.inline(listed))
    flags = each.select(
        *run, "n", "a", "b_system", *[F.array_contains(s, F.col(x)).alias(f"{s}{x}") for s in ("_who", "_good") for x in "ij"])

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    both = F.col("_whoi") & F.col("_whoj")
    return flags.groupBy(*run, "a", "b_system").agg(
        total(both).alias("n_items"), total(F.col("_whoi") != F.col("_whoj")).alias("n_unpaired"),
        total(both & F.col("_goodi") & ~F.col("_goodj")).alias("b"), total(both & ~F.col("_goodi") & F.col("_goodj")).alias("c"))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 P(X <= min(b, c))) for X ~ Binomial(b + c, 1/2), by the running binomial term."""
    n = (b + c).cast("double")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(
            (acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
        )

    tail = F.aggregate(F.sequence(F.lit(0), F.least(b, c).cast("int")), start, step, lambda acc: acc["sum"])
    return F.least(F.lit(1.0), 2 * tail)


def mcnemar(counts: DataFrame) -> DataFrame:
    """Add method, statistic and p-value.  Pairs of runs over different items get none."""
    b, c = F.col("b"), F.col("c")
    n = b + c
    paired = F.col("n_unpaired") == 0
    method = (
        F.when(~paired, F.lit(None).cast("string"))
        .when(n == 0, "none").when(n < EXACT_BELOW, "exact_binomial").otherwise("chi2_cc")
    )
    large = F.col("method") == "chi2_cc"
    corrected = F.pow(F.abs(b - c) - 1, F.lit(2.0)) / n
    out = counts.withColumn("method", method).withColumn("chi2_cc", F.when(large, corrected))
    out = out.withColumn("_tail", chi2_pvalue_1df(F.col("chi2_cc")))
    small = F.when(F.col("method") == "exact_binomial", F.least(b, c)).otherwise(F.lit(0))
    exact = binomial_two_sided(small, F.when(F.col("method") == "exact_binomial", n - F.least(b, c)).otherwise(F.lit(0)))
    return out.withColumn(
        "p",
        F.when(F.col("method") == "none", F.lit(1.0))
        .when(F.col("method") == "exact_binomial", exact)
        .otherwise(F.col("_tail")),
    ).drop("_tail")

