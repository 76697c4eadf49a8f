"""Similarity join of documents by the Jaccard coefficient of their word n-grams, with PartEnum signatures.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased; a shorter text is one
shingle).  Two documents link when ``100 * intersection >= percent * union``; ``link`` gives each document
the smallest id it can reach over links.

Method.  Sets of one size band that link differ in at most ``k`` elements, so of ``k + 1 + s`` parts
of the hashed element domain at least ``s + 1`` agree.  A set enumerates the parts, leaves out its ``s``
smallest (the largest part two sets agree on is never among them) and hashes each other part together
with its band: linked sets share at least one signature.  Bands are ``SPAN`` powers of the size ratio wide; sets near
a border take part in a band across it as well.

1. Equal sets are one class, held by its smallest id; only that document goes on.
2. Signatures are sorted, and each group pairs its members with one of them (its hub), so rows
   grow with the members and not with their pairs.
3. Pairs pass a bitmap filter (parities of the elements bound the difference from below) and then the
   exact comparison of the sets; links give components.
4. Groups that still hold several components are cut into cells of bounded size; inside a
   cell only members of different components are compared by bitmap, and what passes is verified
   exactly.  Thus every pair that shares a signature is linked, refuted or already connected.

Scale.  Texts are read three times and never shuffled while the id sets they are joined with stay below
``graph.BROADCAST_IDS``; what is shuffled is 16 bytes a signature.  Step 4 compares pairs inside groups
that are similar but not connected; its work can grow with the square of such a group, its rows cannot.

Edge cases: null, empty and blank texts have no shingles and link with nothing; rows sharing an id
are one document; a null id stands before all others; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.llm.graph import components, sized, without
from labelloom.llm.words import column_chunks, mix, whole, window_hashes

NO_ID = -(2**63)
SPAN = 2
CELL = 256
_PART, _SUM = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band up to ``largest``, and the last size of each."""
    first, last, size = [], [], 1
    while size <= largest:
        end = size
        for _ in range(SPAN):
            end = end * 100 // percent
        first.append(size)
        last.append(end)
        size = end + 1
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def most_apart(a, b, percent: int):
    """Largest size of the symmetric difference of two linked sets of these sizes."""
    return ((100 - percent) * (a + b)) // (100 + percent)


def shingle_sets(column, n: int):
    """Yield ``(first, last + 1, sorted distinct shingle hashes, offsets of the texts)`` for an Arrow column."""
    for first, last, h, bounds in column_chunks(column, lower=True):
        at, doc = whole(bounds, n)
        value = window_hashes(h, n)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n)):
            run = h[bounds[i] : bounds[i + 1]]
            value = np.append(value, window_hashes(run, len(run), 7))
            doc = np.append(doc, i)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[keep], doc[keep]
        yield first, last, value, np.searchsorted(doc, np.arange(last - first + 1))


def _instances(sizes: np.ndarray, percent: int):
    """``(members, number of the instance, largest difference)`` of the bands and of their borders."""
    first, last = bands(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(first, sizes, side="right") - 1
    yield np.flatnonzero(sizes > 0), 2 * band, most_apart(last[band], last[band], percent)
    # Across the border below size l: partners of sizes [percent * l / 100, l - 1] and [l, (l - 1) * 100 / percent].
    for step in (0, 1):
        border = band + step
        low = np.append(first, last[-1] + 1)[border]
        inside = (sizes < low) & (sizes * 100 >= low * percent) if step else (sizes >= low) & (
            sizes * percent <= (low - 1) * 100) & (band > 0)
        yield np.flatnonzero(inside & (sizes > 0)), 2 * border - 1, most_apart(low - 1, (low - 1) * 100 // percent, percent)


def signatures(value: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes of the sets and the number of the set each belongs to."""
    sizes = np.diff(bounds)
    out, owner = [], []
    for member, number, apart in _instances(sizes, percent):
        member = member[apart[member] > 0]  # sets that must be equal to link are one class already
        if not len(member):
            continue
        k = apart[member]
        drop = (k + 1) // 4
        parts = k + 1 + drop
        count = sizes[member]
        begin = np.concatenate(([0], np.cumsum(parts)))
        at = np.repeat(bounds[member] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        element = mix(value[at] ^ (_PART * np.repeat(number[member].astype(np.uint64) + np.uint64(1), count)))
        slot = np.repeat(begin[:-1], count) + ((element >> np.uint64(20)) % np.repeat(parts, count).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(begin[-1], dtype=np.uint64)
        np.add.at(sums, slot, element * _SUM)
        held = np.bincount(slot, minlength=begin[-1])
        doc = np.repeat(np.arange(len(member)), parts)
        part = np.arange(begin[-1]) - begin[doc]
        rank = np.empty(begin[-1], dtype=np.int64)
        rank[np.lexsort((part, held, doc))] = part  # by size, then by number, within each set
        keep = rank >= drop[doc]
        tag = number[member][doc].astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64)
        out.append(mix(sums + mix(tag + _SUM))[keep])
        owner.append(member[doc][keep])
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(owner)


def bitmap(elements: np.ndarray) -> bytes:
    """Parity of the elements that fall on each of a power of two of bits, at least two bits an element."""
    bits = 64
    while bits < 2 * len(elements):
        bits *= 2
    spot = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(spot.astype(np.uint8), bitorder="little").tobytes()


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the shortest one's length."""
    words = min(map(len, maps)) // 8
    return np.concatenate([_fold(np.frombuffer(m, dtype=np.uint64)[None, :], words) for m in maps])


def bitmap_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Lower bounds of the symmetric differences, pair by pair."""
    out = np.zeros(len(left), dtype=np.int64)
    a, b = (np.fromiter(map(len, maps), dtype=np.int64, count=len(maps)) for maps in (left, right))
    for kind in np.unique(a << 32 | b):
        at = np.flatnonzero((a << 32 | b) == kind)
        words = int(min(kind >> 32, kind & 0xFFFFFFFF)) // 8
        two = [_fold(np.frombuffer(b"".join(maps[i] for i in at), dtype=np.uint64).reshape(len(at), -1), words)
               for maps in (left, right)]
        out[at] = np.bitwise_count(two[0] ^ two[1]).sum(axis=1, dtype=np.int64)
    return out


def _rows(names, *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def _summaries(n: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, value, bounds in shingle_sets(batch.column(2), n):
                total = [np.concatenate(([np.uint64(0)], np.cumsum(mix(value ^ seed), dtype=np.uint64)))
                         for seed in (_PART, _SUM)]
                d1, d2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                maps = [bitmap(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield _rows(("key", "doc_id", "size", "d1", "d2", "bits"), batch.column(0).slice(first, last - first),
                            batch.column(1).slice(first, last - first), np.diff(bounds).astype(np.int64), d1, d2,
                            pa.array(maps, pa.binary()))
    return run


def _signed(n: int, percent: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, value, bounds in shingle_sets(batch.column(1), n):
                sig, owner = signatures(value, bounds, percent)
                if len(sig):
                    yield _rows(("sig", "key"), sig.view(np.int64), keys[first + owner])
    return run


def _sets(n: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, value, bounds in shingle_sets(batch.column(1), n):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                yield _rows(("key", "elements"), batch.column(0).slice(first, last - first), lists)
    return run


def _hubs(batches):
    """Of rows sorted by signature, those of groups with several members, each with its group's hub."""
    held = None  # signature, key and hub of the last row; hub None while it stands alone
    for batch in batches:
        sig, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(sig):
            continue
        hub_before = None
        if held is not None:
            if held[2] is None:
                sig, key = np.append(held[0], sig), np.append(held[1], key)
            elif held[0] == sig[0]:
                hub_before = held[2]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(start, len(sig)))
        hub = np.minimum.reduceat(key, start)
        several = count > 1
        if hub_before is not None:
            hub[0], several[0] = hub_before, True
        hub_row, ok = np.repeat(hub, count), np.repeat(several, count)
        held = (sig[-1], key[-1], hub[-1] if several[-1] else None)
        pick = np.flatnonzero(ok)
        if len(pick):
            yield _rows(("sig", "key", "hub"), sig[pick], key[pick], hub_row[pick])


def _near(percent: int):
    """Of pairs with bitmaps, those whose bitmaps leave room for a link."""
    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            apart = bitmap_distances(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ok = apart <= most_apart(a, b, percent)
            if ok.any():
                yield _rows(("u", "v"), u[ok], v[ok])
    return run


def _cells(percent: int):
    """Of rows sorted by cell, the pairs of different components that the bitmaps leave open."""
    def flush(rows):
        key, comp, size, side = (np.array([r[i] for r in rows]) for i in range(4))
        maps = folded([r[4] for r in rows])
        us, vs = [], []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            j = j[(comp[j] != comp[i]) & (key[j] != key[i]) & ((side[j] != side[i]) | (side[i] == 0))]
            j = j[np.minimum(size[j], size[i]) * 100 >= np.maximum(size[j], size[i]) * percent]
            if len(j):
                apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                j = j[apart <= most_apart(size[j], size[i], percent)]
                us.append(np.maximum(key[j], key[i]))
                vs.append(np.minimum(key[j], key[i]))
        if us and sum(map(len, us)):
            yield _rows(("u", "v"), np.concatenate(us), np.concatenate(vs))

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if row[:3] != cell:
                    if len(rows) > 1:
                        yield from flush(rows)
                    cell, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield from flush(rows)
    return run


def link(docs: DataFrame, *, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key")
    rows = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    thin = stage(rows.mapInArrow(_summaries(n), "key long, doc_id long, size long, d1 long, d2 long, bits binary"), "sets-thin")
    classes = thin.where("size > 0").groupBy("d1", "d2").agg(F.min("key").alias("rep"))
    classes = stage(classes, "set-classes")
    heads = stage(classes.select(F.col("rep").alias("key")).distinct(), "set-heads")
    others = stage(thin.select("key").distinct().join(heads, "key", "left_anti"), "set-copies")

    texts = rows.select("key", "text")
    signed = texts.join(sized(others), "key", "left_anti").mapInArrow(_signed(n, percent), "sig long, key long")
    members = stage(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(
        _hubs, "sig long, key long, hub long"), "signature-groups")

    profile = thin.join(heads, "key", "left_semi").select("key", "size", "bits")
    pairs = members.where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()
    first = _verified(texts, profile, pairs, n, percent, filtered=False)
    label = components(first)

    known = members.select("sig", "key").distinct().join(label.withColumnRenamed("node", "key"), "key", "left").select(
        "sig", "key", F.coalesce("component", "key").alias("comp"))
    known = stage(known, "signature-members")
    open_groups = known.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
    open_groups = open_groups.where("low <> high and members > 2").select(
        "sig", F.ceil(F.col("members") / CELL).cast("int").alias("blocks"))
    inside = known.join(stage(open_groups, "open-groups"), "sig").join(profile, "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    inside = inside.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cells = inside.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                          "key", "comp", "size", side.alias("side"), "bits")
    cells = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    more = cells.mapInArrow(_cells(percent), "u long, v long").distinct()
    second = _verified(texts, profile, more, n, percent, filtered=True)
    label = components(first.unionByName(second))

    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = stage(named, "set-components")
    own = F.coalesce("component", "key")
    return thin.drop("bits").join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.when(own != NO_ID, own)).alias("component_id"))


def _verified(texts: DataFrame, profile: DataFrame, pairs: DataFrame, n: int, percent: int, filtered: bool) -> DataFrame:
    """The pairs ``u, v`` that link, by bitmap first and then by their whole sets (written)."""
    if not filtered:
        left = profile.select(F.col("key").alias("u"), F.col("size").alias("a"), F.col("bits").alias("left"))
        right = profile.select(F.col("key").alias("v"), F.col("size").alias("b"), F.col("bits").alias("right"))
        pairs = pairs.join(left, "u").join(right, "v").where(
            F.least("a", "b") * 100 >= F.greatest("a", "b") * percent).select("u", "v", "a", "b", "left", "right")
        pairs = pairs.mapInArrow(_near(percent), "u long, v long")
    pairs = stage(pairs, "candidate-pairs")
    nodes = stage(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), "candidate-nodes")
    sets = texts.join(sized(nodes), "key", "left_semi").mapInArrow(_sets(n), "key long, elements array<long>")
    sets = stage(sets, "candidate-sets")
    left = sets.select(F.col("key").alias("u"), F.col("elements").alias("left"))
    right = sets.select(F.col("key").alias("v"), F.col("elements").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    tested = pairs.join(left, "u").join(right, "v").where(100 * common >= percent * union)
    return stage(tested.select("u", "v").distinct(), "links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest id, with all its columns.

    Of rows that share an id the one with the smallest text stays.
    """
    linked = stage(link(docs, id_col=id_col, text_col=text_col, **options), "linked")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without(docs, stage(linked.where(~own).select("doc_id").distinct(), "near-copies"), id_col)
    again = stage(linked.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    shared = kept.join(sized(again.select(F.col("doc_id").alias("__again"))),
                       kept[id_col].eqNullSafe(F.col("__again")), "left_semi")
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col), F.xxhash64(*docs.columns)))
    return without(kept, again, id_col).unionByName(shared.withColumn("__turn", turn).where("__turn = 1").drop("__turn"))
