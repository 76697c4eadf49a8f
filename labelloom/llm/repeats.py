"""Substring de-duplication by level-wise doubling.

Words are runs of characters other than U+0020 and U+0009 to U+000D.  A window of ``window`` consecutive words
is a repeat when its word sequence also starts earlier: in a document with a smaller id, or
earlier in the same document.  Every word covered by a repeat is removed; repeats are judged on
the input, not on what is left.

Method.  The lengths double from ``base`` words up to ``window``.  At the first length only the
windows that are the smallest by hash among their neighbours are looked at, chosen so that every
run of ``window`` words holds one, and equal runs the same one.  Windows that repeat at one length, anywhere in the
table, are extended to twice that length, to the left and to the right; at the last length
to every start that contains them.  ``longest_repeats`` goes on doubling until no candidate
survives.

Scale.  Each level shuffles hashes and positions (about one row for eight words at the first
level, only survivors later), sorted by hash; a group of equal hashes is streamed past its
neighbours and never gathered.  A chunk of texts (about a megabyte) sends a hash at most once, so
a passage in every document is no hot key.  Exact copies are found by digest first: only the copy
with the smallest id is searched, the others are repeats from end to end.  The texts are shuffled by id once
and that exchange serves all levels.  At the deciding length two windows are the same when 96 bits of two hashes of their words'
values agree (``words`` states how seldom two words share a value).

Edge cases: a null text has no words; texts below ``window`` words keep everything; rows repeated
under one id neither precede nor repeat each other, and give one row each; a null id stands before all
others; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.llm.words import chunks, column_chunks, mix, parts, whole, window_hashes

NO_ID = -(2**63)


def lengths(window: int, base: int) -> list[int]:
    """The window lengths of the levels, shortest first: halves of ``window`` down to ``base``."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= base:
        out.insert(0, out[0] // 2)
    return out


def _slide(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = op(values[:-have], values[have:])
        have *= 2
    return op(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, window: int) -> np.ndarray:
    """Starts of the ``length``-word windows that are smallest in some run of ``window`` words."""
    width = window - length + 1
    runs, _ = whole(bounds, window)
    if not len(runs):
        return runs
    value = window_hashes(h, length)
    lowest = _slide(np.minimum, value, width)
    in_text = np.zeros(len(value) + width - 1, dtype=np.uint64)
    in_text[width - 1 + runs] = lowest[runs]
    return np.flatnonzero((_slide(np.maximum, in_text, width) == value) & (value > 0))


def extended(starts: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, window: int) -> np.ndarray:
    """Starts of windows of twice the length around surviving ones, kept inside their texts."""
    back = np.arange(length + 1) if 2 * length >= window else np.array([0, length])
    found = starts[:, None] - back[None, :]
    inside = (found >= begin[:, None]) & (found + 2 * length <= end[:, None])
    return np.unique(found[inside])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: A row's ``start`` also tells its part: below it the row is settled and only passes through, with
#: start ``SETTLED - start``; ``WITNESS`` stands for the settled rows of one hash.
WITNESS, SETTLED = -1, -2


def _elsewhere(h: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Another place to send a row to: scattered high bits, the hash's low 32 bits."""
    high = mix(h ^ mix(key.view(np.uint64) + np.uint64(1)) + start.astype(np.uint64))
    return (high & np.uint64(0xFFFFFFFF00000000)) | (h & np.uint64(0xFFFFFFFF))


def repeated_here(h: np.ndarray, key: np.ndarray, start: np.ndarray):
    """Rows to send out for candidates of one chunk of texts: ``(hash, key, start)``.

    A hash that stands several times in the chunk repeats for certain; its rows go past the hash's
    task and one witness is sent there.  So a chunk sends a hash at most one row.
    """
    order = np.argsort(h, kind="stable")
    same = np.append(False, h[order][1:] == h[order][:-1])
    several = np.zeros(len(h), dtype=bool)
    several[order] = same | np.append(same[1:], False)
    witness = order[~same & np.append(same[1:], False)]
    sent = np.where(several, _elsewhere(h, key, start), h)
    return (_signed(np.concatenate((sent, h[witness]))), np.concatenate((key, key[witness])),
            np.concatenate((np.where(several, SETTLED - start, start), np.full(len(witness), WITNESS))).astype(np.int32))


def later_here(h: np.ndarray, h2: np.ndarray, key: np.ndarray, start: np.ndarray):
    """The same for the last level: all but the first place of a hash in the chunk are later ones."""
    order = np.lexsort((start, key, h2, h))
    o = [x[order] for x in (h, h2, key, start)]
    new = np.append(True, (o[0][1:] != o[0][:-1]) | (o[1][1:] != o[1][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(h), dtype=bool)
    later[order] = (o[2] != o[2][first]) | (o[3] != o[3][first])
    sent = np.where(later, _elsewhere(h, key, start), h)
    return _signed(sent), key, np.where(later, SETTLED - start, start).astype(np.int32), _signed(h2).astype(np.int32)


def _batch(names, *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def _lists(column, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    part = column.slice(first, last - first)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _first_level(length: int, window: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, h, bounds in column_chunks(batch.column(1)):
                at = anchors(h, bounds, length, window)
                if len(at):
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    yield _batch(("h", "key", "start"), *repeated_here(
                        window_hashes(h, length)[at], keys[first + doc], at - bounds[doc]))
    return run


def _next_level(length: int, window: int, last_level: bool):
    """From survivors of ``length`` to candidates of twice the length."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, h, bounds in column_chunks(batch.column(1)):
                starts, sizes = _lists(batch.column(2), first, last)
                doc = np.repeat(np.arange(last - first), sizes)
                at = extended(bounds[doc] + starts, bounds[doc], bounds[doc + 1], length, window)
                if not len(at):
                    continue
                doc = np.searchsorted(bounds, at, side="right") - 1
                value, key, start = window_hashes(h, 2 * length)[at], keys[first + doc], at - bounds[doc]
                if last_level:
                    second = window_hashes(h, 2 * length, 1)[at]
                    yield _batch(("h", "key", "start", "h2"), *later_here(value, second, key, start))
                else:
                    yield _batch(("h", "key", "start"), *repeated_here(value, key, start))
    return run


def _keep_repeated(batches):
    """Of rows sorted by hash, those with a neighbour of the same hash."""
    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        settled = cols[2] <= SETTLED
        if settled.any():
            yield _batch(("key", "start"), cols[1][settled], SETTLED - cols[2][settled])
            cols = [c[~settled] for c in cols]
        if not len(cols[0]):
            continue
        flag = np.zeros(len(cols[0]) + (held is not None), dtype=bool)
        if held is not None:
            cols = [np.concatenate(([v], c)) for v, c in zip(held[:3], cols, strict=True)]
            flag[0] = held[3]
        same = cols[0][1:] == cols[0][:-1]
        flag[1:] |= same
        flag[:-1] |= same
        held = (cols[0][-1], cols[1][-1], cols[2][-1], flag[-1])
        pick = np.flatnonzero(flag[:-1] & (cols[2][:-1] >= 0))
        if len(pick):
            yield _batch(("key", "start"), cols[1][pick], cols[2][pick].astype(np.int32))
    if held is not None and held[3] and held[2] >= 0:
        yield _batch(("key", "start"), np.array([held[1]]), np.array([held[2]], dtype=np.int32))


def _keep_later(batches):
    """Of rows sorted by hash, id and start, those whose hash stood at another place before."""
    held = None  # hash, second hash, id and start of the first row of the open group
    for batch in batches:
        h, h2, key, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        settled = start <= SETTLED
        if settled.any():
            packed = ((SETTLED - start[settled]).astype(np.int64) << 32) | (h[settled] & 0xFFFFFFFF)
            yield _batch(("key", "packed"), key[settled], packed)
            h, h2, key, start = (c[~settled] for c in (h, h2, key, start))
        n = len(h)
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        if held is not None:
            new[0] = (h[0], h2[0]) != held[:2]
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_key, first_start = key[first], start[first]
        if held is not None:
            first_key[first < 0], first_start[first < 0] = held[2], held[3]
        pick = np.flatnonzero((key != first_key) | (start != first_start))
        held = (h[-1], h2[-1], first_key[-1], first_start[-1])
        if len(pick):
            packed = (start[pick].astype(np.int64) << 32) | (h[pick] & 0xFFFFFFFF)
            yield _batch(("key", "packed"), key[pick], packed)


def _stripped(texts: list[bytes], bounds: np.ndarray, gone: np.ndarray, copies: np.ndarray, window: int):
    """What is left of each text, and how many words are not."""
    kept, removed = [], []
    for text, a, b, copy in zip(texts, bounds[:-1], bounds[1:], copies, strict=True):
        part = np.full(b - a, b - a >= window) if copy else gone[a:b]
        n = int(part.sum())
        words = text.split() if n < b - a else []
        kept.append(b" ".join(itertools.compress(words, (~part).tolist()) if n else words))
        removed.append(n)
    return kept, removed


def _strip(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, copies = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for at, texts in parts(batch.column(1)):
                for first, last, h, bounds in chunks(texts):
                    starts, sizes = _lists(batch.column(3), at + first, at + last)
                    covered = np.zeros(len(h) + 1, dtype=np.int64)
                    if len(starts):
                        doc = np.repeat(np.arange(last - first), sizes)
                        place = bounds[doc] + (starts >> 32)
                        value = window_hashes(h, window)
                        fits = place + window <= bounds[doc + 1]
                        place, low = place[fits], starts[fits] & 0xFFFFFFFF
                        place = place[(_signed(value[place]) & 0xFFFFFFFF) == low]
                        np.add.at(covered, place, 1)
                        np.add.at(covered, place + window, -1)
                    gone = np.cumsum(covered)[: len(h)] > 0
                    kept, removed = _stripped(texts[first:last], bounds, gone, copies[at + first : at + last], window)
                    yield _batch(("doc_id", "n_words", "n_removed", "kept"), ids.slice(at + first, last - first),
                                 np.diff(bounds).astype(np.int64), np.array(removed, dtype=np.int64),
                                 pa.array(kept, pa.binary()).cast(pa.string()))
    return run


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text")))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts dealt by id, and the digests of the texts whose first copy has that id."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    firsts = rows.select("key", _digest().alias("digest")).groupBy("digest").agg(F.min("key").alias("key"))
    firsts = firsts.groupBy("key").agg(F.collect_list("digest").alias("digests"))
    return rows.repartition("key"), firsts


def _survivors(rows: DataFrame, name: str) -> DataFrame:
    kept = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_keep_repeated, "key long, start int")
    return kept.groupBy("key").agg(F.collect_list("start").alias(name))


def remove_repeats(docs: DataFrame, *, window: int = 20, base: int = 5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words left, joined by one space) for every row."""
    texts, firsts = _prepared(docs, id_col, text_col)
    steps = lengths(window, base)
    if len(steps) == 1:
        raise ValueError("window must be at least twice base, by a power of two")
    searched = texts.join(firsts.hint("shuffle_hash"), "key").where(F.array_contains("digests", _digest()))
    found = searched.select("key", "text").mapInArrow(_first_level(steps[0], window), "h long, key long, start int")
    for length in steps[:-2]:
        near = texts.join(_survivors(found, "starts").hint("shuffle_hash"), "key").select("key", "text", "starts")
        found = near.mapInArrow(_next_level(length, window, False), "h long, key long, start int")
    near = texts.join(_survivors(found, "starts").hint("shuffle_hash"), "key").select("key", "text", "starts")
    found = near.mapInArrow(_next_level(steps[-2], window, True), "h long, key long, start int, h2 int")
    later = found.select("h", "h2", "key", "start").repartition("h").sortWithinPartitions(
        "h", "h2", "key", "start").mapInArrow(_keep_later, "key long, packed long")
    later = later.groupBy("key").agg(F.collect_list("packed").alias("packed"))
    copy = ~F.coalesce(F.array_contains("digests", _digest()), F.lit(False))
    return (texts.join(firsts.hint("shuffle_hash"), "key", "left").join(later.hint("shuffle_hash"), "key", "left")
            .select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "text", copy.alias("copy"), "packed")
            .mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept string"))


def longest_repeats(docs: DataFrame, *, window: int = 20, base: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, start, length``: starts of windows that repeat anywhere, at the largest of the
    lengths ``window``, ``2 * window``, ... at which the window still repeats."""
    texts, firsts = _prepared(docs, id_col, text_col)
    searched = texts.join(firsts, "key").where(F.array_contains("digests", _digest()))
    steps = lengths(window, base)
    found = searched.select("key", "text").mapInArrow(_first_level(steps[0], window), "h long, key long, start int")
    for length in steps[:-1]:
        near = texts.join(_survivors(found, "starts"), "key").select("key", "text", "starts")
        found = near.mapInArrow(_next_level(length, window, False), "h long, key long, start int")
    length, results = window, []
    while True:
        rows = found.repartition("h").sortWithinPartitions("h").mapInArrow(_keep_repeated, "key long, start int")
        alive = stage(rows.distinct(), f"repeats-{length}")
        if alive.isEmpty():
            break
        results.append(alive.withColumn("length", F.lit(length)))
        other = alive.select("key", (F.col("start") - length).alias("start"))
        both = alive.join(other, ["key", "start"]).groupBy("key").agg(F.collect_list("start").alias("starts"))
        near = texts.join(both, "key").select("key", "text", "starts")
        found = near.mapInArrow(_doubled(length), "h long, key long, start int")
        length *= 2
    if not results:
        return docs.sparkSession.createDataFrame([], "doc_id long, start int, length int")
    everything = results[0]
    for part in results[1:]:
        everything = everything.unionByName(part)
    longest = everything.groupBy("key", "start").agg(F.max("length").alias("length"))
    return longest.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "start", "length")


def _doubled(length: int):
    """Windows of twice the length whose both halves repeat."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, h, bounds in column_chunks(batch.column(1)):
                starts, sizes = _lists(batch.column(2), first, last)
                doc = np.repeat(np.arange(last - first), sizes)
                at = bounds[doc] + starts
                at = np.unique(at[at + 2 * length <= bounds[doc + 1]])
                if len(at):
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    yield _batch(("h", "key", "start"), *repeated_here(
                        window_hashes(h, 2 * length)[at], keys[first + doc], at - bounds[doc]))
    return run
