"""Exact ordinal numbers without funnelling a class into one task.

``row_number()`` partitioned by a label has as many tasks as there are labels.  Here the rows
of a partition are first cut into order-preserving buckets; ``row_number`` runs per bucket and
the sizes of the buckets before it are added.  Only the bucket sizes (a small aggregate) are
ever summed in one place, and several levels of buckets keep even that table narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage

HASH_DIGITS = 3  # 4,096 buckets per partition; 4 digits give 65,536


def order_hash(key: Column | str, seed: int | str) -> Column:
    """Deterministic pseudo-random order of keys: md5 of ``key:seed``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def hash_bucket(hashed: Column, digits: int = HASH_DIGITS) -> Column:
    return F.substring(hashed, 1, digits)


def exact_rank(
    df: DataFrame,
    partition: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
) -> DataFrame:
    """Add the 1-based position of each row inside its ``partition``.

    The order is ``levels`` (ascending, coarse to fine) and then ``order``; together they must
    be a total order.  ``levels`` decide the bucket of a row, so no bucket may be hot: take a
    hash prefix, or a leading part of the sort key.  The bucket is one struct column, which
    keeps null partition keys whole and lets the join below reuse the window's partitioning.
    """
    groups = [F.col(c).alias(f"p{i}") for i, c in enumerate(partition)]
    cuts = [c.alias(f"l{i}") for i, c in enumerate(levels)]
    keyed = df.withColumn("_bucket", F.struct(*groups, *cuts))

    # Sizes of all buckets; rows travel only as partial counts.
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = _bucket_offsets(sizes, len(groups), len(cuts))

    inside = Window.partitionBy("_bucket").orderBy(*order)
    numbered = keyed.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, "_bucket")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_offset", "_inside")
    )


def _bucket_offsets(sizes: DataFrame, n_groups: int, n_levels: int) -> DataFrame:
    """Rows that come before each bucket, summed level by level."""

    def prefix(depth: int) -> Column:
        fields = [f"p{i}" for i in range(n_groups)] + [f"l{i}" for i in range(depth)]
        if not fields:
            return F.lit(0)
        return F.struct(*[F.col(f"_bucket.{f}").alias(f) for f in fields])

    def running(table: DataFrame, *keep: str) -> DataFrame:
        so_far = (
            Window.partitionBy("_parent")
            .orderBy("_at")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        before = F.sum("_size").over(so_far) - F.col("_size")
        return table.select(*keep, before.alias("_before"))

    def level(depth: int) -> list[Column]:
        return [prefix(depth - 1).alias("_parent"), F.col(f"_bucket.l{depth - 1}").alias("_at"), F.col("_size")]

    # The finest level is the bucket itself; each coarser one adds the rows before its node.
    out = running(sizes.select("_bucket", *level(n_levels)), "_bucket")
    out = out.withColumnRenamed("_before", "_offset")
    for depth in range(n_levels - 1, 0, -1):
        nodes = (
            sizes.select(prefix(depth).alias("_node"), *level(depth))
            .groupBy("_node", "_parent", "_at")
            .agg(F.sum("_size").alias("_size"))
        )
        out = (
            out.withColumn("_node", prefix(depth))
            .join(running(nodes, "_node"), "_node")
            .select("_bucket", (F.col("_offset") + F.col("_before")).alias("_offset"))
        )
    return out


def dealt_in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` written in ``order``, with ``_at``: number of the range (high bits) and place in it (low 33 bits).

    The cut points are the quantiles Spark samples for a range shuffle, with a second sample of
    input partitions that hold much, so ranges follow the data: one constant value or one
    hot key is cut by whatever comes after it in the order, and full ties are cut by a hash of
    the row's place.  ``df`` is read twice (sample and shuffle): give a written table of thin rows.
    """
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie")
    return stage(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "in-order")


def range_rank(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    total: str | None = None,
    group_no: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its ``partition``; no buckets need be named.

    Rows are dealt into sampled ranges of (partition, order) and numbered where they lie; one row
    for each range and partition value is summed up.  ``total`` names a column for the size of the partition,
    ``group_no`` one for the 0-based number of the partition value (ascending, null first).
    Full ties are numbered in any order.  Runs jobs: the dealt rows are written.
    """
    keyed = df.withColumn("_group", F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(partition)], F.lit(0).alias("one")))
    written = dealt_in_order(keyed, [*[F.col(c).asc_nulls_first() for c in partition], *order])
    written = written.withColumn("_range", F.shiftright("_at", 33))
    runs = written.groupBy("_range", "_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    own = Window.partitionBy("_group")
    earlier = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("_size").over(own))
    if group_no:
        # A partition value is counted in the range it begins in.
        runs = runs.withColumn("_begins", (F.col("_before") == 0).cast("long"))
        begun = runs.groupBy("_range").agg(F.sum("_begins").alias("_begun"))
        ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        begun = begun.select("_range", F.coalesce(F.sum("_begun").over(ranges), F.lit(0)).alias("_begun"))
        inside = Window.partitionBy("_range").orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = runs.withColumn("_inside", F.sum("_begins").over(inside)).join(begun, "_range")
        runs = runs.withColumn(group_no, F.col("_begun") + F.col("_inside") - 1)
    extra = [c for c in (total, group_no) if c]
    ranked = written.join(runs.select("_range", "_group", "_first", "_before", *extra), ["_range", "_group"])
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return ranked.withColumn(name, place.cast("long")).drop("_range", "_group", "_at", "_first", "_before")


def hash_rank(
    df: DataFrame,
    partition: Sequence[str],
    key: str,
    seed: int | str,
    name: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rank by ``md5(key:seed)`` inside ``partition``: the order every split and sample uses."""
    hashed = df.withColumn("_hash", order_hash(key, seed))
    return exact_rank(
        hashed,
        partition,
        levels=[hash_bucket(F.col("_hash"), digits)],
        order=[F.col("_hash"), F.col(key)],
        name=name,
    ).drop("_hash")


def row_ids(df: DataFrame, file_order: str, position: str, name: str = "id") -> DataFrame:
    """1-based row ids over pooled sources, in (file order, position) order."""
    return exact_rank(
        df,
        partition=[],
        levels=[F.col(file_order), F.shiftright(F.col(position).cast("long"), 16)],
        order=[F.col(position)],
        name=name,
    )


def first_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int,
            name: str = "rank") -> DataFrame:
    """Top ``k`` rows per partition.  Spark trims every map task to ``k`` rows per group before
    the shuffle (window group limit), so a hot group never travels whole."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
