"""Merkle manifest of a table, with proofs gathered by pointer jumping.

Every row is a leaf: the digest of its fields, each framed by its length.  The leaves of one group (a source) ascend
by id and form a tree whose nodes hash the hexadecimal text of ``fan`` consecutive children (the last node of a level
may have fewer, even one).  The roots of the groups, in the order of the groups, are the leaves of a top tree.

Method.  Levels are built from below, one shuffle each, and a level has a third of the rows of the one beneath; each
run of children is at hand there, so every node gets its first pointer (to its parent) and its first segment (the siblings
left and right of it).  Then pointers jump: a self-join hands each node the pointer and the segment of the node it
points at, and the segments are joined up.  That doubles the distance, so after ``ceil(log2(height))`` joins every leaf
points at the root and holds its whole proof.  A round keeps only the levels later rounds can reach.

Scale.  Texts are read once, for their digests; what is shuffled is 32-byte digests.  Leaves are numbered in
ranges cut by the data, so one source may hold any share of the rows.  The leaves below one node meet it in several
tasks: pointers and nodes are salted by the number of leaves below (``SALT`` of them share a copy).
Inner nodes are written to the shared folder in each round, and leaves run through all joins in one job.

Edge cases: a null field is ``-`` and differs from an empty one; null ids come first, the null group is a group of its own and
first; rows repeated under one id are leaves each, ordered by digest; a group of one row is its own root, and so is
the only group; an empty table gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.operators.ranking import range_rank

#: Leaves that share one copy of the node they point at.
SALT = 4096
TOP = -1
STEPS = "array<struct<left: binary, right: binary>>"
NODE = ("tree", "level", "at")
POINTER = ("up_tree", "up_level", "up_at", "up_weight", "up_digest", "subroot", "steps")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    """SHA-256 of a string or binary column, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def record(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field as ``-`` (null) or its length in bytes, a colon and its text."""
    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest_of(F.concat(*[framed(f) for f in fields]))


def fold(leaf: Column, steps: Column) -> Column:
    """Root that a leaf and its segments lead to."""
    return F.aggregate(steps, leaf, lambda below, s: digest_of(
        F.concat(hexed(s["left"]), hexed(below), hexed(s["right"]))))


def siblings(steps: Column) -> Column:
    """Hexadecimal text of all siblings, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def _heights(size: int, fan: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // fan), levels + 1
    return levels


def _climb(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Levels of all trees of ``nodes`` (tree, at, size, weight, digest, id, carry), each written once: a row per parent
    with its ``run`` of children; then the root of every tree, and the height of the largest."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    written, roots = [], nodes.where("size = 1").select("tree", "digest", "weight")
    for level in range(_heights(largest, fan)):
        parents = nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("at") / fan).alias("up")).agg(
            F.sum("weight").alias("weight"),
            F.array_sort(F.collect_list(F.struct("at", "digest", "weight", "id", "carry"))).alias("run"))
        parents = parents.withColumn("digest", digest_of(F.array_join(F.transform("run", lambda c: hexed(c["digest"])), "")))
        parents = stage(parents.withColumn("level", F.lit(level)), "merkle-level")
        written.append(parents)
        rest = F.ceil(F.col("size") / fan)
        nodes = parents.select("tree", F.col("up").alias("at"), rest.alias("size"), "weight", "digest",
                               F.lit(None).cast(nodes.schema["id"].dataType).alias("id"),
                               F.lit(None).cast(nodes.schema["carry"].dataType).alias("carry"))
        roots = roots.unionByName(nodes.where("size = 1").select("tree", "digest", "weight"))
    return written, roots, len(written)


def _pointers(parents: DataFrame, fan: int) -> DataFrame:
    """Children of one level with their pointer to the parent and the siblings beside them."""
    def joined(part):
        return F.coalesce(F.aggregate(part, F.unhex(F.lit("")), lambda a, c: F.concat(a, c["digest"])), F.unhex(F.lit("")))

    each = parents.select("*", F.posexplode("run").alias("pos", "child"))
    is_root = F.col("size") <= fan
    sub = F.col("tree") != TOP
    step = F.struct(joined(F.slice("run", F.lit(1), F.col("pos"))).alias("left"),
                    joined(F.slice("run", F.col("pos") + 2, F.lit(fan))).alias("right"))
    return each.select(
        "tree", "level", F.col("child.at").alias("at"), F.col("child.weight").alias("weight"),
        F.col("child.id").alias("id"), F.col("child.digest").alias("digest"), F.col("child.carry").alias("carry"),
        # The root of a group's tree is a leaf of the top tree.
        F.when(is_root, F.when(sub, F.lit(TOP))).otherwise(F.col("tree")).alias("up_tree"),
        F.when(is_root, 0).otherwise(F.col("level") + 1).alias("up_level"),
        F.when(is_root, F.col("tree").cast("long")).otherwise(F.col("up")).alias("up_at"),
        F.col("weight").alias("up_weight"), F.col("digest").alias("up_digest"),
        F.when(is_root & sub, F.col("digest")).alias("subroot"), F.array(step).cast(STEPS).alias("steps"))


def _jump(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with the pointer and segment of the node they point at joined to their own."""
    copies = F.ceil(F.col("weight") / SALT).cast("int")
    to = targets.select(*[F.col(c).alias(f"t_{c}") for c in (*NODE, *POINTER)],
                        F.explode(F.sequence(F.lit(0), copies - 1)).alias("t_salt"))
    own = F.pmod(F.xxhash64(*NODE), F.ceil(F.col("up_weight") / SALT)).cast("int")
    both = rows.withColumn("salt", own).join(
        to, [F.col("up_tree") == F.col("t_tree"), F.col("up_level") == F.col("t_level"), F.col("up_at") == F.col("t_at"),
             F.col("salt") == F.col("t_salt")], "left")
    far = F.col("t_tree").isNotNull()  # a pointer at the root stays
    moved = [F.when(far, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in POINTER[:5]]
    return both.select(*[c for c in rows.columns if c not in POINTER], *moved,
                       F.coalesce("subroot", "t_subroot").alias("subroot"),
                       F.when(far, F.concat("steps", "t_steps")).otherwise(F.col("steps")).alias("steps"))


def prove(rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf",
          carry: Sequence[str] = (), fan: int = 3) -> DataFrame:
    """``id, leaf, carry, subroot, root, steps`` for every row of ``rows`` (thin rows with a digest each); runs jobs.

    ``steps`` holds the siblings left and right on each level from the leaf to the root; ``carry`` is a struct of the
    named columns.
    """
    # One field more, so that the struct exists without any column.
    kept = F.struct(*[F.col(c) for c in carry], F.lit(True).alias("kept"))
    thin = stage(rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(leaf_col).alias("digest"),
                             kept.alias("carry")), "merkle-leaves")
    ranked = range_rank(thin, ["grp"], [F.col("id").asc_nulls_first(), F.col("digest").asc()], name="place",
                        total="size", group_no="tree")
    leaves = ranked.select(F.col("tree").cast("int").alias("tree"), (F.col("place") - 1).alias("at"), "size",
                           F.lit(1).cast("long").alias("weight"), "digest", "id", "carry")
    written, roots, low = _climb(leaves, fan)
    tops = stage(roots, "merkle-subroots")
    tops = tops.select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("at"),
                       F.lit(tops.count()).cast("long").alias("size"), "weight", "digest",
                       F.lit(None).cast(thin.schema["id"].dataType).alias("id"),
                       F.lit(None).cast(thin.schema["carry"].dataType).alias("carry"))
    above, _, high = _climb(tops, fan)

    # A row that is all of its group points at itself as the group's root, with nothing to hash beside it.
    alone = leaves.where("size = 1").select(
        "tree", F.lit(0).alias("level"), "at", "weight", "id", "digest", "carry", F.lit(TOP).alias("up_tree"),
        F.lit(0).alias("up_level"), F.col("tree").cast("long").alias("up_at"), F.lit(1).cast("long").alias("up_weight"),
        F.col("digest").alias("up_digest"), F.col("digest").alias("subroot"), F.array().cast(STEPS).alias("steps"))
    each = [_pointers(p, fan) for p in written]
    walkers = alone.unionByName(each[0]) if each else alone
    inner = None
    for level in [*each[1:], *[_pointers(p, fan) for p in above]]:
        level = level.drop("id", "digest", "carry")
        inner = level if inner is None else inner.unionByName(level)
    distance = 1
    # A row alone in its group stands one step nearer, so that its way is at most the largest tree's.
    while inner is not None and distance < low + high + 1:
        inner = stage(inner, "merkle-pointers")
        at_top = F.col("tree") == TOP
        targets = inner.where(at_top | (F.col("level") % (2 * distance) == distance))
        walkers = _jump(walkers, targets)
        inner = _jump(inner.where(at_top | (F.col("level") % (2 * distance) == 0)), targets)
        distance *= 2
    return walkers.select("id", F.col("digest").alias("leaf"), "carry", "subroot", F.col("up_digest").alias("root"), "steps")
