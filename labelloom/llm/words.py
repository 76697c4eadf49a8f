"""Words of texts as 64-bit hashes, computed for whole Arrow batches with NumPy.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, taken unchanged.  Texts are
handled in chunks of about a megabyte, so memory follows the chunk and the longest text's words,
not the batch.

Error bound.  Words of up to seven bytes have values of their own.  Longer ones are taken in blocks of eight bytes with a
bijective scramble after each, so two different ones share a value with a probability of about 2**-64 (for two
given words; no pattern of letters collides by construction).  Windows combine the values of their halves the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this are hashed one by one.
_VERY_LONG = 512
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\x09-\x0d\x20]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer (zeros beyond the end)."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit value per span of bytes: equal bytes give equal values wherever they stand."""
    at, size = _blocks(data), ends - starts
    out = at[starts] & _MASK[np.minimum(size, 8)]
    longer = size > 7
    out = mix(np.where(longer, out ^ _BASE, out | (size.astype(np.uint64) << np.uint64(56))))
    rest = np.flatnonzero(longer)
    out[rest] = mix(out[rest] * _BASE + size[rest].astype(np.uint64))
    for i in rest[size[rest] > _VERY_LONG].tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    rest, done = rest[size[rest] <= _VERY_LONG], 8
    while len(rest := rest[size[rest] > done]):
        block = at[starts[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]
        out[rest] = mix(out[rest] * _BASE + block)
        done += 8
    return out


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span with the number in ``others``."""
    at, size = _blocks(data), ends - starts
    same = size == size[others]
    rest, done = np.flatnonzero(same & (others != np.arange(len(others)))), 0
    while len(rest):
        mask = _MASK[np.minimum(size[rest] - done, 8)]
        same[rest] = (at[starts[rest] + done] & mask) == (at[starts[others[rest]] + done] & mask)
        done += 8
        rest = rest[same[rest] & (size[rest] > done)]
    return same


def _long(text: bytes) -> np.ndarray:
    """Word hashes of one text longer than a chunk, cut between words."""
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = _BREAK.search(text, end)
            end = cut.start() if cut else len(text)
        part = np.frombuffer(text, dtype=np.uint8, count=min(end, len(text)) - at, offset=at)
        out.append(hashes(part, *spans(part)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last + 1, word hashes, word offsets of the texts)`` for runs of whole texts."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            h = _long(texts[at])
            yield at, at + 1, h, np.array([0, len(h)])
            at += 1
            continue
        last, size = at, 0
        while last < len(texts) and size + len(texts[last]) <= CHUNK:
            size += len(texts[last]) + 1
            last += 1
        data = np.frombuffer(b"\n".join(texts[at:last]) + b"\n", dtype=np.uint8)
        starts, ends = spans(data)
        lengths = np.fromiter((len(t) + 1 for t in texts[at:last]), dtype=np.int64, count=last - at)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        yield at, last, hashes(data, starts, ends), np.searchsorted(starts, bounds)
        at = last


def parts(column, limit: int = 2 * CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """An Arrow string column as bytes (null is empty), a few megabytes at a time, each with the
    number of its first row.  Memory that Arrow has done with goes back at the end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = column.cast(pa.binary())
    sizes = pc.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, [b"" if v is None else v for v in data.slice(at, end - at).to_pylist()]
        at = end
    pa.default_memory_pool().release_unused()


def column_chunks(column, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """:func:`chunks` of a whole Arrow column, rows counted from its first; ``lower`` turns A-Z to a-z."""
    for at, texts in parts(column):
        for first, last, h, bounds in chunks([t.lower() for t in texts] if lower else texts):
            yield at + first, at + last, h, bounds


def window_hashes(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values (also across texts: mask those).

    The value of a run follows from those of its parts of 1, 2, 4, ... values, the longest part first."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - length + 1
    part = mix(h + np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    parts = [part]
    while 2 ** len(parts) <= length:
        half = 2 ** (len(parts) - 1)
        part = mix(part[:-half] * _BASE + part[half:])
        parts.append(part)
    out, done = None, 0
    for k in range(len(parts) - 1, -1, -1):
        if length >> k & 1:
            own = parts[k][done : done + n]
            out = own if out is None else mix(out * _BASE + own)
            done += 2**k
    return out


def whole(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window that lies inside one text, and that text's number."""
    counts = np.diff(offsets)
    room = np.maximum(counts - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), room)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return np.arange(len(doc)) + first, doc
