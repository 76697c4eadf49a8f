"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) take the given weights in turn.  Together they get
``share`` times the words of the table; a target stops at ``limit`` times its source's size and
the excess is shared again by weight, which is the level ``min(limit * size, level * weight)``.

The documents of a source are dealt by hash into blocks of about ``block_docs`` documents.  A source draws
whole passes over its blocks and then a permuted prefix of them; inside the one block where the
target falls, documents are drawn in hash order up to the target.  The number of blocks each
source draws is its exact quota.  A binary tree splits these quotas among the output shards: each
node gives half of its draws to its left child, and how many of them belong to each source is drawn from
the multivariate hypergeometric distribution, source by source.  The leaves cut each source's
permuted draws into disjoint runs, one for each shard, and a shard is shuffled locally by hash.

Everything is DataFrame expressions.  Only sums travel: one row per source, one per block.  No
task holds a source; the largest group is one block.

Edge cases: a null text has size 0; a null source is a source of its own; a null id is hashed as
the word ``null``; repeated rows are drawn independently of each other (equal rows are
interchangeable); documents of size 0 and empty tables draw nothing but keep their row; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: ln(n!) for n from 0 to 9; beyond, Stirling's series is exact to ten digits.
LN_FACTORIAL = [math.log(math.factorial(n)) for n in range(10)]


def hash_number(text: Column) -> Column:
    """The first 32 bits of the md5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Add ``no`` (rank of the source from 0), ``weight`` and ``target`` to one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * limit
    s = sources.withColumn("no", rank).withColumn("weight", weight).withColumn("cap", cap)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.select(
        "*", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)).alias("filled"),
        F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)).alias("gone"),
        F.sum("weight").over(everything).alias("weights"),
        (F.sum("source_size").over(everything) * share).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("filled")) / (F.col("weights") - F.col("gone")))
    # Sources before the first that keeps below its cap are full; later candidates are lower.
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    wanted = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "no", "source_size", "n_docs", wanted.alias("target"))


def ln_factorial(n: Column) -> Column:
    v = n.cast("double")
    series = (v * F.ln(v) - v + 0.5 * F.ln(2 * math.pi * v) + 1 / (12 * v) - 1 / (360 * v * v * v)
              + 1 / (1260 * v * v * v * v * v))
    small = F.element_at(F.array(*[F.lit(x) for x in LN_FACTORIAL]), F.greatest(n, F.lit(0)).cast("int") + 1)
    return F.when(n < len(LN_FACTORIAL), small).otherwise(series)


def hypergeometric(good: Column, bad: Column, draws: Column, uniform: Column) -> Column:
    """Number of good ones among ``draws`` from ``good + bad``, by inversion around the mean."""
    everything = good + bad
    mean = draws * good / F.greatest(everything, F.lit(1))
    reach = 10 * F.sqrt(mean * bad / F.greatest(everything, F.lit(1))) + 10
    low = F.greatest(F.lit(0), draws - bad, F.floor(mean - reach)).cast("long")
    high = F.least(good, draws, F.ceil(mean + reach)).cast("long")
    norm = (ln_factorial(good) + ln_factorial(bad) + ln_factorial(draws) + ln_factorial(everything - draws)
            - ln_factorial(everything))

    def step(acc: Column, x: Column) -> Column:
        density = F.exp(norm - ln_factorial(x) - ln_factorial(good - x) - ln_factorial(draws - x)
                        - ln_factorial(bad - draws + x))
        return F.struct(
            (acc["sum"] + density).alias("sum"),
            F.when(acc["sum"] < uniform, x).otherwise(acc["pick"]).alias("pick"))

    first = F.struct(F.lit(0.0).alias("sum"), low.alias("pick"))
    return F.aggregate(F.sequence(low, F.greatest(low, high)), first, step)["pick"]


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``no, ends``: for each source, how many of its draws lie before the end of each shard."""

    def left(node: Column) -> Column:
        def step(acc: Column, item: Column) -> Column:
            uniform = hash_number(F.concat_ws(":", F.lit("split"), F.lit(seed), node, item["no"])) / float(1 << 32)
            rest = acc["rest"] - item["quota"]
            x = hypergeometric(item["quota"], rest, acc["draws"], uniform).cast("long")
            return F.struct(rest.alias("rest"), (acc["draws"] - x).alias("draws"),
                            F.concat(acc["taken"], F.array(x)).alias("taken"))

        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, item: a + item["quota"])
        first = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("draws"),
                         F.array().cast("array<bigint>").alias("taken"))
        return F.aggregate("quotas", first, step)["taken"]

    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("no", F.col("quota").cast("long").alias("quota")))).alias("quotas"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(levels):
        nodes = nodes.select("node", "quotas", left(F.col("node")).alias("taken"))
        one = F.zip_with("quotas", "taken", lambda q, x: F.struct(q["no"].alias("no"), x.alias("quota")))
        two = F.zip_with("quotas", "taken", lambda q, x: F.struct(q["no"].alias("no"), (q["quota"] - x).alias("quota")))
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), one.alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), two.alias("quotas")))).alias("child")).select("child.*")
    each = nodes.select("node", F.explode("quotas").alias("q")).groupBy(F.col("q.no").alias("no")).agg(
        F.sort_array(F.collect_list(F.struct("node", F.col("q.quota").alias("quota")))).alias("shards"))
    ends = F.aggregate("shards", F.array().cast("array<bigint>"), lambda acc, s: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + s["quota"])))
    return each.select("no", ends.alias("ends"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_docs: int = 512,
        levels: int = 4, seed: int = 0, carry: bool = False) -> DataFrame:
    """``doc_id, source, size, source_size, target, draws`` for every row of ``docs``.

    ``draws`` holds one ``(copy, shard, position)`` for each time the document is taken;
    ``2 ** levels`` shards; ``position`` is the key of the local shuffle.  With ``carry`` the whole
    input row comes along as the struct ``row``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(f"doc{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    named = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")]
    thin = stage(docs.select(*named), "mix-sizes")

    per_source = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(per_source, weights, share, limit)
    passes = F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    goal = stage(goal.select(
        "*", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"),
        F.ceil(F.col("n_docs") / block_docs).cast("long").alias("n_blocks")), "mix-targets")
    goal = goal.withColumnRenamed("source", "of_source")

    def in_blocks(rows: DataFrame) -> DataFrame:
        block = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("n_blocks")
        return rows.join(goal, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("block", block)

    drawn_before = Window.partitionBy("no").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.md5(F.concat_ws(":", F.lit(f"block{seed}"), "no", "block"))
    blocks = in_blocks(thin).groupBy("no", "block").agg(
        F.sum("size").alias("block_size"), *[F.first(c).alias(c) for c in ("passes", "rest", "n_blocks")])
    blocks = blocks.withColumn("turn", turn).select(
        "no", "block", "passes", "rest", F.col("n_blocks").alias("in_source"),
        F.coalesce(F.sum("block_size").over(drawn_before), F.lit(0)).alias("block_before"),
        (F.row_number().over(Window.partitionBy("no").orderBy("turn", "block")) - 1).cast("long").alias("place"))
    blocks = stage(blocks, "mix-blocks")
    quotas = blocks.groupBy("no").agg(
        (F.first("passes") * F.count(F.lit(1)) + F.count_if(F.col("block_before") < F.col("rest"))).alias("quota"))
    ends = split_quotas(quotas, levels, seed)

    placed = blocks.join(ends, "no").select("no", "block", "block_before", "place", "in_source", "ends")
    rows = docs.select(*named, F.struct(*[docs[c] for c in docs.columns]).alias("row")) if carry else thin
    placed = in_blocks(rows).join(placed, ["no", "block"])
    before = Window.partitionBy("no", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words_before = F.col("block_before") + F.coalesce(F.sum("size").over(before), F.lit(0))
    times = F.col("passes") + F.when(words_before + F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("times", times)

    def draw(copy: Column) -> Column:
        turn_no = copy * F.col("in_source") + F.col("place")
        shard = F.size(F.filter("ends", lambda end: end <= turn_no))
        position = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "key", copy.cast("string")))
        return F.struct(copy.cast("int").alias("copy"), shard.alias("shard"), position.alias("position"))

    draws = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), draw))
    none = F.array().cast("array<struct<copy:int,shard:int,position:string>>")
    return placed.select("doc_id", "source", "size", "source_size", "target", F.coalesce(draws, none).alias("draws"),
                         *(["row"] if carry else []))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is drawn, dealt by shard and shuffled there.

    A shard is dealt to several tasks by the first digits of the shuffle's key.
    """
    each = mix(docs, carry=True, **options).select("row", F.explode("draws").alias("draw"))
    each = each.select("row", "draw.shard", "draw.position")
    each = each.repartition("shard", F.substring("position", 1, 2)).sortWithinPartitions("shard", "position")
    return each.select("row.*")
