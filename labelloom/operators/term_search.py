"""Search of a bounded block of terms in texts, over whole Arrow batches with NumPy.

All bytes of a text that may begin a term are looked up length by length: eight bytes at a place are one integer, up to eight of them are
compared as they are, longer ones by a 64-bit value and then byte for byte, so a hit is exact.  Places whose first 4, 8, 16, ... bytes begin no
longer term are left out before longer ones are tried.

``whole`` texts are searched place by place.  Otherwise the terms hold no blank: a slice of texts is cut at blanks, each distinct word of
the slice is searched once, and a text unites the terms of its words.

Memory follows the block, ``SLICE`` bytes of text and ``HELD`` pairs, not the batch; a longer text is taken in slices as well, a word
without a blank is not cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Bytes of texts whose distinct words are searched together.
SLICE = 2 << 20
#: Places looked up together, pairs of texts and terms held together.
STEP = 1 << 17
PLACES = 1 << 19
HELD = 1 << 19
#: Words beyond this are searched as often as they stand.
LONG = 512
#: Of terms with more bytes than these (at least 4, 8), the first ones are kept in filters.
FILTERED = (4, 8, 16)
_FILTER = np.uint64(42)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.int64((1 << 32) - 1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(8, dtype=np.uint8)))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of padded bytes on as one integer."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _short(first: np.ndarray, size) -> np.ndarray:
    """Value of up to eight bytes: for a size, different bytes have different values."""
    return scramble((first & _MASK[size]) + np.asarray(size).astype(np.uint64) * _SIZE)


def _longer(state: np.ndarray, tail: np.ndarray, size) -> np.ndarray:
    """Value of more than eight bytes: ``state`` of all whole eights before the last byte, and the last eight."""
    return scramble((state ^ scramble(tail)) + np.asarray(size).astype(np.uint64) * _SIZE)


def values(at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of runs of bytes; equal runs have equal ones."""
    first = at[begin]
    out = _short(first, np.minimum(size, 8))
    rest = np.flatnonzero(size > 8)
    state, k = scramble(first[rest]), 1
    while len(rest):
        more = size[rest] > 8 * k + 8
        end = rest[~more]
        out[end] = _longer(state[~more], at[begin[end] + size[end] - 8], size[end])
        rest, state = rest[more], state[more]
        state = scramble(state ^ at[begin[rest] + 8 * k])
        k += 1
    return out


def equal(at: np.ndarray, begin: np.ndarray, other: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of the same sizes hold the same bytes."""
    out = (at[begin] ^ other[where]) & _MASK[np.minimum(size, 8)] == 0
    rest = np.flatnonzero(out & (size > 8))
    k = 1
    while len(rest):
        to = np.minimum(8 * k, size[rest] - 8)
        same = at[begin[rest] + to] == other[where[rest] + to]
        out[rest[~same]] = False
        rest = rest[same & (size[rest] > 8 * k + 8)]
        k += 1
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Terms:
    """A block of terms in the order of their values: their padded bytes one after another, their sizes, and a code below
    ``len(profiles)`` each."""

    def __init__(self, data: np.ndarray, size: np.ndarray, code: np.ndarray, profiles: np.ndarray):
        self.data, self.size, self.code, self.profiles = data, size, code, profiles

    @classmethod
    def of(cls, batches: list) -> Terms:
        """From Arrow batches of terms (binary) and profiles; the list is emptied, so that they need not be held."""
        import pyarrow as pa

        terms = pa.concat_arrays([pa.array([], pa.binary()), *[b.column(0) for b in batches]])
        codes = pa.chunked_array([b.column(1) for b in batches], pa.int64()).combine_chunks().dictionary_encode()
        batches.clear()
        offsets, data = _bytes(terms)
        order = np.argsort(_values_of_all(eights(padded(data)), offsets[:-1], np.diff(offsets)))
        profiles, code = codes.dictionary.to_numpy(), codes.indices.to_numpy()[order]
        offsets, data = _bytes(terms.take(pa.array(order)))
        size = np.diff(offsets)
        return cls(padded(data), size.astype(np.min_scalar_type(size.max(initial=0))), code.astype(np.min_scalar_type(len(profiles))), profiles)

    @cached_property
    def index(self) -> Index:
        """Made once in a worker."""
        return Index.of(self)


def _values_of_all(at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of many runs, some at a time; runs without bytes come first and have none."""
    out = np.zeros(len(size), dtype=np.uint64)
    for i in range(0, len(size), STEP):
        own = size[i:i + STEP].astype(np.int64)
        out[i:i + STEP] = np.where(own > 0, values(at, begin[i:i + STEP], own), 0)
    return out


@dataclass(frozen=True)
class Index:
    """Terms by value.  ``first`` has the place of the first one of each bucket of values."""

    at: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    code: np.ndarray
    first: np.ndarray
    shift: np.uint64
    lengths: list[int]
    #: Whether terms begin with bytes of a value, by ``FILTERED``.
    begins: dict[int, np.ndarray]

    @classmethod
    def of(cls, terms: Terms) -> Index:
        at, size = eights(terms.data), terms.size
        begin = np.zeros(len(size), dtype=np.int32 if len(at) < 1 << 31 else np.int64)
        np.cumsum(size[:-1], out=begin[1:])
        value = _values_of_all(at, begin, size)
        bits = max(8, len(size).bit_length())
        shift = np.uint64(64 - bits)
        first = np.zeros((1 << bits) + 1, dtype=np.int32)
        begins = {to: np.zeros(1 << (64 - int(_FILTER)), dtype=bool) for to in FILTERED}
        there = np.zeros(int(size.max(initial=0)) + 1, dtype=bool)
        for i in range(0, len(size), STEP):
            first[1:] += np.bincount((value[i:i + STEP] >> shift).astype(np.int64), minlength=1 << bits)
            there[size[i:i + STEP]] = True
        np.cumsum(first, out=first)
        lengths = [n for n in np.flatnonzero(there).tolist() if n]
        for i in range(0, len(size), STEP):
            own = np.arange(i, min(i + STEP, len(size)))
            state = np.zeros(len(own), dtype=np.uint64)
            for to in FILTERED:
                stay = size[own] >= to if to <= 8 else size[own] > to
                own, state = own[stay], state[stay]
                if to <= 8:
                    state = scramble(at[begin[own]] & _MASK[to])
                else:
                    state = scramble(state ^ at[begin[own].astype(np.int64) + (to - 8)])
                begins[to][state >> _FILTER] = True
        return cls(at, value, begin, size, terms.code, first, shift, lengths, begins)

    def hits(self, at: np.ndarray, place: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of places and the terms that stand there, no longer than the room is."""
        if not self.lengths:
            return
        longest = self.lengths[-1]
        kind = np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.int64
        order = np.argsort(longest - np.minimum(room, longest).astype(kind), kind="stable")
        for i in range(0, len(order), STEP):
            own = order[i:i + STEP]
            yield from self._look(at, own, place[own], -np.minimum(room[own], longest))

    def _look(self, at, own, where, less) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``less``: negative rooms, most room first."""
        eight, state, done = at[where], None, 0
        for size in self.lengths:
            n = int(np.searchsorted(less, -size, side="right"))
            own, where, less, eight = own[:n], where[:n], less[:n], eight[:n]
            state = None if state is None else state[:n]
            while done < 8 and done + 4 <= size or done + 8 < size:
                done = done + 4 if done < 8 else done + 8
                state = scramble(eight & _MASK[done] if done <= 8 else state ^ at[where + (done - 8)])
                if done in self.begins:
                    stay = np.flatnonzero(self.begins[done][state >> _FILTER])
                    own, where, less, eight, state = own[stay], where[stay], less[stay], eight[stay], state[stay]
            if not len(own):
                return
            value = _short(eight, size) if size <= 8 else _longer(state, at[where + (size - 8)], size)
            bucket = value >> self.shift
            term, end = self.first[bucket], self.first[bucket + np.uint64(1)]
            some = np.flatnonzero(term < end)
            term, end = term[some], end[some]
            while len(some):
                same = np.flatnonzero(self.value[term] == value[some])
                same = same[self.size[term[same]] == size]
                if size > 8:
                    t = term[same]
                    same = same[equal(at, where[some[same]], self.at, self.begin[t], self.size[t].astype(np.int64))]
                if len(same):
                    yield own[some[same]], term[same]
                term = term + 1
                more = term < end
                some, term, end = some[more], term[more], end[more]

    def pairs(self, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sorted ``run << 32 | term`` for the terms that stand in runs of bytes."""
        out, total = [np.zeros(0, dtype=np.int64)], np.concatenate(([0], np.cumsum(size)))
        for low in range(0, int(total[-1]), PLACES):
            high = min(low + PLACES, int(total[-1]))
            a, b = np.searchsorted(total, low, side="right") - 1, np.searchsorted(total, high, side="left")
            runs = np.arange(a, b)
            run = np.repeat(runs, np.minimum(total[a + 1:b + 1], high) - np.maximum(total[a:b], low))
            place = np.arange(low, high) - total[run] + begin[run]
            # No term begins within a letter.
            head = np.flatnonzero((at[place] & np.uint64(0xC0)) != np.uint64(0x80))
            run, place = run[head], place[head]
            room = begin[run] + size[run] - place
            found = [(run[i] << 32) | term for i, term in self.hits(at, place, room)]
            if found:
                out.append(distinct(np.concatenate(found)))
        return distinct(np.concatenate(out)) if len(out) > 2 else out[-1]


def _bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow array of strings or binaries."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    return at, np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes and offsets of about ``SLICE`` bytes of texts; a longer text is cut at blanks."""
    at, texts = 0, len(offsets) - 1
    while at < texts:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if high - low <= SLICE:
            yield at, data[low:high], offsets[at:end + 1] - low
        else:
            while low < high:
                cut = min(low + SLICE, high)
                while cut < high and data[cut] != 32:
                    to = min(cut + SLICE, high)
                    blank = np.flatnonzero(data[cut:to] == 32)
                    cut = cut + int(blank[0]) if len(blank) else to
                yield at, data[low:cut], np.array([0, cut - low])
                low = cut
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and size of each piece between blanks that is not empty."""
    blanks = np.flatnonzero(data == 32)
    begin = np.sort(np.concatenate((offsets[:-1], blanks + 1)), kind="stable")
    end = np.sort(np.concatenate((blanks, offsets[1:])), kind="stable")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(blanks, offsets)) + 1)
    some = np.flatnonzero(end > begin)
    return text[some], begin[some], end[some] - begin[some]


def grouped(at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word of each group of equal words, and the group of each word."""
    group = np.full(len(begin), -1, dtype=np.int64)
    short = np.flatnonzero(size <= LONG)
    value = values(at, begin[short], size[short])
    order = np.argsort(value)
    value = value[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, dtype=bool)
    one = short[order[new]]
    group[short[order]] = np.cumsum(new) - 1
    pick = one[group[short]] if len(one) else one
    same = size[short] == size[pick]
    longer = np.flatnonzero(same & (size[short] > 8))  # up to eight bytes a size and a value are the word
    same[longer] = equal(at, begin[short[longer]], at, begin[pick[longer]], size[pick[longer]])
    group[short[~same]] = -1
    alone = np.flatnonzero(group < 0)
    group[alone] = len(one) + np.arange(len(alone))
    return np.concatenate((one, alone)), group


def _united(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted ``text << 32 | term`` for terms without a blank, a text at most in two neighbouring ones."""
    at = eights(padded(data))
    text, begin, size = words(data, offsets)
    one, group = grouped(at, begin, size)
    held = index.pairs(at, begin[one], size[one])
    first = np.searchsorted(held, np.arange(len(one) + 1) << 32)
    held &= _LOW
    pair = distinct((text << 32) | group)
    text, group = pair >> 32, pair & _LOW
    n = first[group + 1] - first[group]
    total = np.concatenate(([0], np.cumsum(n)))
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(total, total[low] + HELD, side="right")) - 1)
        own = n[low:high]
        take = np.repeat(first[group[low:high]] - (total[low:high] - total[low]), own) + np.arange(total[high] - total[low])
        yield distinct((np.repeat(text[low:high], own) << 32) | held[take])
        low = high


def found(index: Index, array, whole: bool) -> Iterator[np.ndarray]:
    """Sorted ``text << 32 | term`` for the texts of an Arrow array; all of a text together."""
    offsets, data = _bytes(array)
    rest = np.zeros(0, dtype=np.int64)
    for first, part, own in slices(data, offsets) if not whole else [(0, data[offsets[0]:offsets[-1]], offsets - offsets[0])]:
        for some in _united(index, part, own) if not whole else [index.pairs(eights(padded(part)), own[:-1], np.diff(own))]:
            if not len(some):
                continue
            some = some + (np.int64(first) << 32)
            if len(rest):
                some = distinct(np.concatenate((rest, some))) if rest[-1] >> 32 == some[0] >> 32 else np.concatenate((rest, some))
            cut = np.searchsorted(some, some[-1] >> 32 << 32)
            rest = some[cut:]
            yield some[:cut]
    yield rest


def counter(shared, whole: bool):
    """A function for ``mapInArrow`` over ``(id, text)``: ``(id, profile, k)``, how many terms of each profile of the shared block a text holds."""

    def run(batches):
        import pyarrow as pa

        terms = shared.value
        index = terms.index
        empty = terms.code[terms.size == 0]
        names = ["id", "profile", "k"]
        for batch in batches:
            ids = batch.column(0)
            for code in empty.tolist():
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(ids), terms.profiles[code])), pa.array(np.ones(len(ids), dtype=np.int64))], names=names)
            for pairs in found(index, batch.column(1), whole):
                if not len(pairs):
                    continue
                at, k = np.unique((pairs >> 32) * len(terms.profiles) + index.code[pairs & _LOW], return_counts=True)
                text, code = np.divmod(at, len(terms.profiles))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(terms.profiles[code]), pa.array(k)], names=names)

    return run
