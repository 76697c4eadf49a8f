"""Connected components of a table of links, and joins against id sets of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.staging import stage

#: Ids that may be sent to every executor (a few dozen megabytes).
BROADCAST_IDS = 2_000_000


def sized(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a written table), marked for broadcast when it has at most ``limit`` rows."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (a written table ``doc_id``; null equals null)."""
    gone = sized(ids.select(F.col("doc_id").alias("__gone")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for ``u, v``; nodes without a link are absent.

    Every round each node takes its smallest neighbour for its parent, links are carried over to
    the parents, and labels follow; rounds end when no link joins two different nodes.  Each
    round is written to the shared folder, so only the last one is ever computed again.
    """
    edges = stage(links.where("u <> v").select("u", "v").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        parent = stage(parent.select("node", F.least("node", "low").alias("parent")), "parents")
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            up = parent.select(F.col("node").alias("component"), "parent")
            labels = stage(labels.join(up, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")), "labels")
        if edges.isEmpty():
            return labels
        left = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        edges = edges.join(left, "u").join(right, "v").where("pu <> pv").select(
            F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        edges = stage(edges, "edges")
