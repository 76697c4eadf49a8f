"""Exact top-k search by integer inner product, with norm-bucketed retrieval.

Every component x becomes floor(256 * x).  Queries are the rows whose id is divisible by ``every``; their
candidates are all rows with another id.

Method.  Vectors are grouped by length into buckets (powers of ``RATIO``), and a bucket into blocks of about
``BLOCK`` vectors by hash.  Each query first meets one block of the longest well-filled bucket, whose k-th
score is a lower bound for its answer.  Blocks of buckets too short for that bound are left out before anything is shuffled.  The others it
meets with a local threshold for the cosine, bound / (length of the
query * greatest length in the block).  Above 1 the block is skipped; when it is high, vectors are
pruned by coordinate: a cosine of t confines each coordinate of the unit vector to an interval around t
times the query's; when it is low, they are pruned by length.  What is left is verified by exact
products.

Scale.  Queries are repeated once for each block in reach and sorted behind the block's vectors; a task holds one
block and streams the queries past it.  Each block returns at most k rows for each query.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; shorter vectors (also empty ones) are filled up with zeros; rows repeated with id and vector
count once; rows sharing an id with different vectors are candidates and queries of their own; ties go to the
smaller id; products beyond 53 bits are computed with whole numbers, and scores outside the range of
a long are held at its ends and rank there; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage

RATIO = 1.1
BLOCK = 4096
#: Local cosine from which coordinates prune better than lengths, and how many coordinates are looked at.
HIGH_COSINE, FOCUS = 0.5, 4
_EXACT = float(1 << 52)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def matrix(column) -> np.ndarray:
    """Quantised vectors as rows of doubles, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


class Block:
    """The vectors of one block, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        length = np.sqrt((rows * rows).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.unit = self.rows / np.maximum(self.length, 1e-300)[:, None]

    def open(self, query: np.ndarray, length: float, bound: float) -> np.ndarray | None:
        """Numbers of the vectors that can reach ``bound``; None means all."""
        if not bound > 0:
            return None
        if length == 0 or self.length[0] == 0:
            return np.zeros(0, dtype=np.int64)
        cosine = bound / (length * self.length[0]) * (1 - 1e-9)
        if cosine > 1:
            return np.zeros(0, dtype=np.int64)
        if cosine < HIGH_COSINE:
            return np.arange(np.searchsorted(-self.length, -bound / length * (1 - 1e-9), side="right"))
        unit, ok = query / length, np.ones(len(self.ids), dtype=bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            reach = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] * unit[f]))) + 1e-9
            ok &= np.abs(self.unit[:, f] - cosine * unit[f]) <= reach if cosine > abs(unit[f]) else (
                self.unit[:, f] * np.sign(unit[f]) >= cosine * abs(unit[f]) - reach)
        return np.flatnonzero(ok)

    def best(self, own: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best that are not the query's own."""
        length = float(np.sqrt((query * query).sum()))
        pick = self.open(query, length, bound)
        rows, ids = (self.rows, self.ids) if pick is None else (self.rows[pick], self.ids[pick])
        if not len(ids):
            return ids, []
        if length * self.length[0] < _EXACT:
            score = rows @ query
        else:
            whole = [int(x) for x in query]
            exact = [sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows]
            score = np.array([max(LOWEST, min(HIGHEST, x)) for x in exact] + [None], dtype=object)[:-1]
        mine = ids != own
        ids, score = ids[mine], score[mine]
        if len(ids) > k and score.dtype != object:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= floor], score[score >= floor]
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
        return ids[order], [int(score[i]) for i in order]


def _meet(k: int):
    """Rows sorted by block, vectors before queries; yields each query's best of the block."""
    def run(batches):
        import pyarrow as pa

        block_no, ids, rows, block = None, [], [], None
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            is_query = batch.column(1).to_numpy(zero_copy_only=False)
            own, q_key = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            vectors = matrix(batch.column(4))
            bound = batch.column(5).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            found: list[tuple] = []
            for part in np.split(np.arange(len(number)), cut):
                if not len(part):
                    continue
                if number[part[0]] != block_no:
                    block_no, ids, rows, block = number[part[0]], [], [], None
                if not is_query[part[0]]:
                    ids.append(own[part])
                    rows.append(vectors[part])
                    continue
                if not ids:
                    continue
                if block is None:
                    width = max(r.shape[1] for r in rows)
                    block = Block(np.concatenate(ids), np.concatenate([_wide(r, width) for r in rows]))
                width = block.rows.shape[1]
                for i in part:
                    query = _wide(vectors[i : i + 1], width)[0, :width]  # beyond the block's width all are zero
                    got, score = block.best(own[i], query, bound[i] if bound[i] == bound[i] else 0.0, k)
                    found += [(q_key[i], own[i], v, s) for v, s in zip(got.tolist(), score, strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["q_key", "query_id", "vec_id", "score"])
    return run


def bucket_of(length: Column) -> Column:
    """Number of the length bucket."""
    return F.floor(F.log(F.greatest(length, F.lit(1.0))) / math.log(RATIO)).cast("int")


def reachable_blocks(queries: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """``queries`` (length, bound, ...) once for each ``block`` that can hold a vector of their best.

    A product is at most the product of the lengths, so only vectors of ``bound / length`` and more count.  Blocks are numbered by
    bucket, shortest first: what is left of them is a run up to the last.  One row a bucket is looked up, and no row is
    made for a block that is out of reach.
    """
    starts = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket", "first"))).alias("s")).scalar()
    needed = bucket_of(F.col("bound") / F.col("length") * (1 - 1e-9))
    open_from = F.get(F.filter("_starts", lambda s: s["bucket"] >= F.col("_needed")), F.lit(0))["first"]
    placed = queries.withColumn("_starts", starts).withColumn(
        "_needed", F.when((F.col("bound") > 0) & (F.col("length") > 0), needed))
    placed = placed.withColumn("_low", F.when(F.col("_needed").isNull(), F.lit(0)).otherwise(F.coalesce(open_from, F.lit(total))))
    run = F.when(F.col("_low") < total, F.sequence(F.col("_low").cast("long"), F.lit(max(total - 1, 0)).cast("long")))
    return placed.select(*queries.columns, F.explode(run).alias("block"))


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of every query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~odd).distinct()
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * 256).cast("double") * F.floor(
        x.cast("double") * 256).cast("double"))
    rows = rows.select("vec_id", "v", F.sqrt(squares).alias("length"))
    rows = stage(rows.withColumn("bucket", bucket_of(F.col("length"))), "vectors")

    first = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    buckets = stage(buckets.withColumn("first", F.coalesce(F.sum("blocks").over(first), F.lit(0))), "buckets")
    total = buckets.agg(F.sum("blocks").alias("blocks")).first().blocks or 0
    probe = buckets.orderBy((F.col("n") >= 16 * k).desc(), F.col("bucket").desc()).select("first", "blocks").first()

    number = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    blocks = rows.join(F.broadcast(buckets), "bucket").select(
        number.cast("long").alias("block"), F.lit(False).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("q_key"),
        "v", F.lit(None).cast("double").alias("bound"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vec_id", "v").alias("q_key"), "v", "length")

    def meet(asking: DataFrame, among: DataFrame) -> DataFrame:
        both = among.unionByName(asking.withColumn("is_query", F.lit(True)))
        both = both.repartition("block").sortWithinPartitions("block", "is_query")
        return both.mapInArrow(_meet(k), "q_key long, query_id long, vec_id long, score long")

    low, count = (probe["first"], probe["blocks"]) if probe else (0, 1)
    chosen = (F.pmod(F.col("q_key"), F.lit(count)) + low).cast("long")
    probed = meet(queries.drop("length").withColumn("block", chosen).withColumn("bound", F.lit(None).cast("double")),
                  blocks.where(F.col("block").between(low, low + count - 1)))
    bounds = probed.groupBy("q_key").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("bound"))
    bounds = bounds.where(F.col("n") >= k).select("q_key", "bound")
    asking = reachable_blocks(queries.join(bounds, "q_key", "left"), buckets, total).drop("length")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), "vec_id"))
    return meet(asking, blocks).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
