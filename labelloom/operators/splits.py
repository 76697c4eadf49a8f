"""Deterministic stratified splits, folds and samples.

Membership follows the order of ``md5(key:seed)`` inside each class, sizes follow largest
remainders, so any engine can recompute them.  All functions return thin tables
``(key, label, ...)``; join them to the texts once, at the end.

The number of classes is given by the declared label list: the quota tables have exactly one
row per listed label, which is why they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.arrays import label_index
from labelloom.functions.staging import stage
from labelloom.operators.ranking import exact_rank, hash_bucket, hash_rank, order_hash

PARTS = ("train", "val", "test")


def _class_counts(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """``(_code, n_class, n_all)`` for every listed label, absent ones with 0."""
    counted = df.groupBy(label_index(label, list(labels)).alias("_code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    row = counted.agg(
        F.coalesce(F.map_from_entries(F.collect_list(F.struct("_code", "n")))).alias("m"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"),
    )
    return row.select(
        F.explode(F.array(*[F.lit(i) for i in range(len(labels))])).alias("_code"), "m", "n_all"
    ).select(
        "_code", F.coalesce(F.element_at("m", F.col("_code")), F.lit(0)).alias("n_class"), "n_all"
    )


def _largest_remainder(table: DataFrame, size: str, total: str, draws: Column, out: str,
                       within: Sequence[str] = ()) -> DataFrame:
    """Share ``draws`` among the classes in proportion to ``size``; exact integer arithmetic.

    The left-over units go to the largest remainders, ties to the lower class code.  The table
    has one row per class (and per ``within`` group).
    """
    scaled = F.col(size).cast("decimal(38,0)") * draws.cast("decimal(20,0)")
    total_c = F.greatest(F.col(total), F.lit(1)).cast("decimal(20,0)")
    base = table.select(
        "*", F.floor(scaled / total_c).cast("long").alias("_lr_approx"), draws.cast("long").alias("_lr_draws")
    )
    # The decimal quotient is rounded; settle the floor exactly from the product.
    product = F.col(size).cast("decimal(38,0)") * F.col("_lr_draws").cast("decimal(20,0)")
    rest0 = product - F.col("_lr_approx").cast("decimal(20,0)") * total_c
    fixed = base.select(
        "*",
        (F.col("_lr_approx") + F.when(rest0 < 0, -1).when(rest0 >= total_c, 1).otherwise(0)).alias("_lr_floor"),
    )
    rest = product - F.col("_lr_floor").cast("decimal(20,0)") * total_c
    grouped = fixed.withColumn("_lr_rest", rest.cast("decimal(38,0)"))
    by = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return (
        grouped.withColumn("_lr_left", F.col("_lr_draws") - F.sum("_lr_floor").over(by))
        .withColumn("_lr_place", F.row_number().over(by.orderBy(F.desc("_lr_rest"), "_code")))
        .withColumn(out, F.col("_lr_floor") + (F.col("_lr_place") <= F.col("_lr_left")).cast("long"))
        .drop("_lr_approx", "_lr_draws", "_lr_floor", "_lr_rest", "_lr_left", "_lr_place")
    )


def _ranked(df: DataFrame, key: str, label: str, labels: Sequence[str], seed: int) -> DataFrame:
    thin = df.select(key, label, label_index(label, list(labels)).alias("_code"))
    return hash_rank(thin, ["_code"], key, seed)


def split_quotas(
    df: DataFrame, label: str, labels: Sequence[str], first: float, second: float,
) -> DataFrame:
    """Per class the sizes of a two-stage split.

    Stage one sets ``ceil(first * n)`` rows aside; stage two draws ``ceil(second * rest)`` out
    of the part it is applied to.  Largest remainders decide the class shares of the part that
    stays; the drawn part takes the rest of each class.  Columns: ``keep1`` (rows of the class
    not set aside), ``keep2`` (rows of the class kept by stage two out of those set aside).
    """
    counts = _class_counts(df, label, labels)
    aside = F.ceil(F.lit(first) * F.col("n_all")).cast("long")
    t = _largest_remainder(counts, "n_class", "n_all", F.col("n_all") - aside, "keep1")
    t = t.withColumn("n_aside", F.col("n_class") - F.col("keep1"))
    t = t.withColumn("all_aside", F.sum("n_aside").over(Window.partitionBy(F.lit(0))))
    drawn = F.ceil(F.lit(second) * F.col("all_aside")).cast("long")
    return _largest_remainder(t, "n_aside", "all_aside", F.col("all_aside") - drawn, "keep2")


def stratified_split(
    df: DataFrame, key: str, label: str, labels: Sequence[str], seed: int,
    held_out: float = 0.2, test_share: float = 0.5,
) -> DataFrame:
    """Train / val / test: ``held_out`` is set aside first and then cut into val and test."""
    quotas = split_quotas(df, label, labels, held_out, test_share)
    # Ranks run: test rows first, then val, then train.
    cuts = quotas.select(
        "_code",
        (F.col("n_aside") - F.col("keep2")).alias("_test"),
        F.col("n_aside").alias("_held"),
    )
    return (
        _ranked(df, key, label, labels, seed)
        .join(F.broadcast(cuts), "_code")
        .select(
            key, label,
            F.when(F.col("rank") <= F.col("_test"), "test")
            .when(F.col("rank") <= F.col("_held"), "val")
            .otherwise("train")
            .alias("split"),
        )
    )


def nested_split(
    df: DataFrame, key: str, label: str, labels: Sequence[str], seed: int,
    test_frac: float = 0.2, val_frac_of_train: float = 0.1,
) -> DataFrame:
    """Test set first, then a validation share of the *remaining* rows."""
    counts = _class_counts(df, label, labels)
    n_test = F.ceil(F.lit(test_frac) * F.col("n_all")).cast("long")
    t = _largest_remainder(counts, "n_class", "n_all", F.col("n_all") - n_test, "rest")
    t = t.withColumn("all_rest", F.sum("rest").over(Window.partitionBy(F.lit(0))))
    n_val = F.ceil(F.lit(val_frac_of_train) * F.col("all_rest")).cast("long")
    t = _largest_remainder(t, "rest", "all_rest", F.col("all_rest") - n_val, "train")
    cuts = t.select(
        "_code",
        (F.col("n_class") - F.col("rest")).alias("_test"),
        (F.col("n_class") - F.col("train")).alias("_held"),
    )
    return (
        _ranked(df, key, label, labels, seed)
        .join(F.broadcast(cuts), "_code")
        .select(
            key, label,
            F.when(F.col("rank") <= F.col("_test"), "test")
            .when(F.col("rank") <= F.col("_held"), "val")
            .otherwise("train")
            .alias("split"),
        )
    )


# ------------------------------------------------------------------------------------ folds
def _fold_quotas(df: DataFrame, label: str, labels: Sequence[str], k: int,
                 val_frac: float) -> DataFrame:
    """Per class: offset, size and, per fold, the class size outside the fold and the number
    of validation rows drawn from it.  k x classes rows, folded back to one row per class."""
    counts = _class_counts(df, label, labels)
    ordered = Window.partitionBy(F.lit(0)).orderBy("_code").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offset = counts.withColumn("_offset", F.sum("n_class").over(ordered) - F.col("n_class"))
    per_fold = offset.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    shift = F.pmod(F.col("_offset") - F.col("_fold"), F.lit(k))
    in_fold = _hits_before(F.col("n_class"), shift, k)
    per_fold = per_fold.withColumn("_rest", F.col("n_class") - in_fold)
    by_fold = Window.partitionBy("_fold")
    per_fold = per_fold.withColumn("_all_rest", F.sum("_rest").over(by_fold))
    n_val = F.ceil(F.lit(val_frac) * F.col("_all_rest")).cast("long")
    per_fold = _largest_remainder(
        per_fold, "_rest", "_all_rest", F.col("_all_rest") - n_val, "_train", within=["_fold"]
    )
    return per_fold.groupBy("_code").agg(
        F.max("_offset").alias("_offset"),
        F.array_sort(
            F.collect_list(
                F.struct("_fold", "_rest", (F.col("_rest") - F.col("_train")).alias("_val"))
            )
        ).alias("_folds"),
    )


def _hits_before(n: Column, shift: Column, k: int) -> Column:
    """How many r in [0, n) satisfy (r + shift) mod k == 0."""
    return F.floor((n + shift + F.lit(k - 1)) / F.lit(k)).cast("long") - F.floor(
        (shift + F.lit(k - 1)) / F.lit(k)
    ).cast("long")


def stratified_kfold(
    df: DataFrame, key: str, label: str, labels: Sequence[str], seed: int,
    k: int = 10, val_frac: float = 1.0 / 9.0,
) -> DataFrame:
    """``(key, label, fold, parts)``: ``fold`` is where the row is tested, ``parts[f]`` its role
    in fold f.

    Classes are laid end to end in hash order and dealt out to the folds in turn.  Inside fold
    f the validation rows are a stretch of the remaining rows of each class, starting at a
    place that moves with f.  Both are arithmetic on one rank, so the k roles of a row cost no
    shuffle beyond the ranking.
    """
    quotas = _fold_quotas(df, label, labels, k, val_frac)
    ranked = _ranked(df, key, label, labels, seed).join(F.broadcast(quotas), "_code")
    pos = F.col("rank") - 1
    dealt = ranked.withColumn("fold", F.pmod(pos + F.col("_offset"), F.lit(k)).cast("int"))

    def role(q: Column) -> Column:
        shift = F.pmod(F.col("_offset") - q["_fold"], F.lit(k))
        place = (F.col("rank") - 1) - _hits_before(F.col("rank") - 1, shift, k)
        start = F.floor(q["_fold"] * q["_rest"] / F.lit(k)).cast("long")
        turned = F.pmod(place - start, F.greatest(q["_rest"], F.lit(1)))
        return (
            F.when(F.col("fold") == q["_fold"], "test")
            .when(turned < q["_val"], "val")
            .otherwise("train")
        )

    return dealt.select(key, label, "fold", F.transform("_folds", role).alias("parts"))


def _snake(place: Column, k: int) -> Column:
    """Fold of the place-th item when folds are dealt 0..k-1, k-1..0, 0..k-1, ..."""
    turn = F.pmod(place, F.lit(2 * k))
    return F.when(turn < k, turn).otherwise(F.lit(2 * k - 1) - turn).cast("int")


def _snake_hits_before(place: Column, fold: Column, k: int) -> Column:
    """How many earlier places the snake gave to ``fold``."""
    full = F.floor(place / F.lit(2 * k)).cast("long") * 2
    turn = F.pmod(place, F.lit(2 * k))
    return full + (turn > fold).cast("long") + (turn > (F.lit(2 * k - 1) - fold)).cast("long")


def group_table(df: DataFrame, group: str, label: str, labels: Sequence[str]) -> DataFrame:
    """One row per group: size and dominant label (ties to the earlier label)."""
    code = label_index(label, list(labels))
    tallies = [F.count_if(F.col("_c") == i).alias(f"_n{i}") for i in range(len(labels))]
    counted = (
        df.select(group, code.alias("_c"))
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_rows"), *tallies)
    )
    sizes = F.array(*[F.col(f"_n{i}") for i in range(len(labels))])
    top = F.array_position(sizes, F.array_max(sizes)).cast("int") - 1
    return counted.select(group, "n_rows", top.alias("_code"))


def stratified_group_kfold(
    df: DataFrame, key: str, group: str, label: str, labels: Sequence[str], seed: int,
    k: int = 10, val_frac: float = 1.0 / 9.0,
) -> DataFrame:
    """Like :func:`stratified_kfold`, but a group never straddles two parts.

    Groups are ordered by size (large first) and hash inside their dominant label and dealt to
    the folds in a snake; in fold f every ``round(1 / val_frac)``-th of the remaining groups
    (again in a snake, whose start moves with f) is validation.  Sizes and label shares are
    balanced by this order, not guaranteed.  The group table is written once (a job).
    """
    inner = round(1.0 / val_frac)
    groups = group_table(df, group, label, labels).withColumn("_hash", order_hash(group, seed))
    ranked = exact_rank(
        stage(groups, "groups"),
        ["_code"],
        levels=[-F.col("n_rows"), hash_bucket(F.col("_hash"))],
        order=[F.col("_hash"), F.col(group)],
    )
    placed = ranked.withColumn("_place", F.col("rank") - 1)
    placed = placed.withColumn("fold", _snake(F.col("_place"), k))

    def role(f: Column) -> Column:
        rest = F.col("_place") - _snake_hits_before(F.col("_place"), f, k)
        return (
            F.when(F.col("fold") == f, "test")
            .when(_snake(rest + f, inner) == 0, "val")
            .otherwise("train")
        )

    roles = placed.select(
        group, "fold", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), role).alias("parts")
    )
    return df.select(key, group, label).join(roles, group).select(
        key, label, group, "fold", "parts"
    )


def fold_membership(folds: DataFrame, key: str, only: Sequence[int] | None = None) -> DataFrame:
    """Long membership ``(fold, part, key)``; ``only`` restricts it to some folds."""
    long = folds.select(key, F.posexplode_outer("parts").alias("fold", "part")).select("fold", "part", key)
    return long if only is None else long.filter(F.col("fold").isin(*only))


def fold_partition_check(folds: DataFrame, key: str, k: int) -> DataFrame:
    """Out-of-fold test sets must partition the data.

    Counts keys that are tested never or more than once, and keys that occur more than once
    (a repeated key could sit in two parts of one fold).
    """
    tested = F.size(F.filter("parts", lambda p: p == "test"))
    per_key = (
        folds.select(key, tested.cast("long").alias("_t"), (F.size("parts") != k).alias("_bad"))
        .groupBy(key)
        .agg(F.sum("_t").alias("t"), F.count(F.lit(1)).alias("n"), F.max("_bad").alias("bad"))
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("t") == 0).alias("never_tested"),
        F.count_if(F.col("t") > 1).alias("tested_twice"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.count_if(F.col("bad")).alias("wrong_length"),
    )


# -------------------------------------------------------------------------------- sampling
def stratified_sample(
    df: DataFrame, key: str, label: str, labels: Sequence[str], n: int, seed: int
) -> DataFrame:
    """Outcome-free sample: per true class ``max(1, floor(n / classes))`` keys in hash order."""
    per_class = max(1, n // len(labels))
    thin = df.select(key, label, label_index(label, list(labels)).alias("_code"))
    hashed = thin.withColumn("_hash", order_hash(key, seed))
    w = Window.partitionBy("_code").orderBy("_hash", key)
    # Window group limit trims each map task to ``per_class`` rows per class.
    return (
        hashed.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= per_class)
        .select(key, label)
    )


def head_per_split(df: DataFrame, split: str, order: Column, sizes: dict[str, int]) -> DataFrame:
    """The first n rows of each split, for smoke runs."""
    w = Window.partitionBy(split).orderBy(order)
    limit = max(sizes.values())
    ranked = df.filter(F.col(split).isin(*sizes)).withColumn("_r", F.row_number().over(w))
    ranked = ranked.filter(F.col("_r") <= limit)
    quota = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))])
    return ranked.filter(F.col("_r") <= quota[F.col(split)]).drop("_r")


def split_report(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows per split and label."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def fold_report(folds: DataFrame, label: str) -> DataFrame:
    """Rows per fold, part and label, without writing out the k-fold membership: the roles are
    aggregated per distinct (label, parts) first."""
    patterns = folds.groupBy(label, "parts").agg(F.count(F.lit(1)).alias("n"))
    return (
        patterns.select(label, "n", F.posexplode_outer("parts").alias("fold", "part"))
        .groupBy("fold", "part", label)
        .agg(F.sum("n").alias("n"))
    )
