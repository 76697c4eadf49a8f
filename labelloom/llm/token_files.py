"""Token ids as Parquet list columns: written in document order, read selectively.

Method: every text is encoded with a public tokenizer, the documents are dealt out by id range and
sorted, and each range becomes one Parquet file whose list column ``ids`` is dictionary-encoded
(the vocabulary fits one dictionary page) with small row groups and pages.  Lengths and offsets
stand in columns of their own, delta-encoded, so metadata can be read without touching a token,
and the page index lets a reader fetch the pages of a few documents.

Columns: ``doc_id``, ``part`` (number of the range), ``offset`` (ids before the document within
the range), ``n_tokens``, ``ids`` (end id last).

Edge cases: a null text is empty and holds the end id alone; an empty table writes a table with no
rows; rows repeated under one id are all kept, ordered by id and then by text; a null id comes
first; columns besides the id and the text are not written.
"""

from __future__ import annotations

import zlib
import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.words import equal, hashes, spans

SCHEMA = "doc_id long, part int, offset long, n_tokens int, ids array<int>"
#: Pieces whose ids a worker remembers before it starts over.
REMEMBERED = 400_000
_encoders: dict[str, "Encoder"] = {}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


class Encoder:
    """Ids of whole texts, remembering the ids of pieces.

    White space always separates the tokenizer's pieces, and so does the step between an ASCII letter
    and an ASCII mark other than the apostrophe; no rule looks across either.  A text's ids
    are therefore the ids of these pieces in order.  ASCII and Latin pieces are cut further by the
    tokenizer's own pattern and go to its model; all others go through the complete tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = regex.compile(r"[\x21-\x7e¡-įı-ɏ]*")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[bytes, int] = {}  # piece -> number of its entry
        self.entries: list[bytes] = []  # ids as little-endian 32-bit integers
        self.fast = self._same_rules()

    def _same_rules(self) -> bool:
        """True when the file's normaliser and pattern are the ones handled piece by piece."""
        import json

        parts = json.loads(self.tokenizer.to_str())
        return (
            [n["type"] for n in parts["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": self.pieces.pattern}
        )

    def _model(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.letters))]

    def piece(self, piece: bytes) -> bytes:
        if self.fast and piece.isalpha():  # ASCII letters only
            ids = self._model(piece.lower())
        else:
            text = piece.decode()
            if not self.fast or "<|" in text or not self.plain.fullmatch(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = [i for p in self.pieces.findall(text.lower()) for i in self._model(p.encode())]
        return np.array(ids, dtype="<i4").tobytes()

    def chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        raw = b"\n".join(texts) + b"\n"
        plain = self.fast and b"<|" not in raw
        if plain:
            raw = raw.lower()
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, ends = spans(data)
        if plain and len(starts):
            letter, mark = _LETTER[data], _MARK[data]
            step = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
            starts, ends = np.sort(np.concatenate((starts, step))), np.sort(np.concatenate((ends, step)))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        pieces = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        # Hashes find pieces that are alike; the bytes decide.
        _, first, place = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        unlike = np.flatnonzero(~equal(data, starts, ends, first[place]))
        if len(unlike):
            place[unlike] = len(first) + np.arange(len(unlike))
            first = np.concatenate((first, unlike))
        known, entries = self.known, self.entries
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        numbers = list(map(known.get, keys))
        if len(entries) + numbers.count(None) > REMEMBERED and entries:
            known.clear()
            entries.clear()
            numbers = [None] * len(keys)
        for i, n in enumerate(numbers):
            if n is None:
                n = known.get(keys[i])
                if n is None:
                    n = known[keys[i]] = len(entries)
                    entries.append(self.piece(keys[i]))
                numbers[i] = n
        own = list(map(entries.__getitem__, numbers))
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat, begin = np.frombuffer(b"".join(own), dtype="<i4"), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        each = sizes[place]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(begin[place] - total[:-1], each) + np.arange(total[-1])]
        return ids, np.diff(total[pieces])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text", row_group: int = 8 << 20, page: int = 64 << 10) -> None:
    """Encode every whole text and write the token table to ``path`` (one job)."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from labelloom.llm.words import parts

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for first, texts in parts(batch.column(1)):
                ids, counts = encoder(tokenizer).chunk(texts)
                sizes = counts + 1
                total = np.concatenate(([0], np.cumsum(sizes)))
                out = np.empty(total[-1], dtype=np.int32)
                out[total[1:] - 1] = end_id
                spot = np.ones(len(out), dtype=bool)
                spot[total[1:] - 1] = False
                out[spot] = ids
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, n), pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(before + total[:-1]), pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(out)),
                ], names=["doc_id", "part", "offset", "n_tokens", "ids"])
                before += int(total[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA)
     .write.option("parquet.block.size", row_group).option("parquet.page.size", page)
     .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token table; select the columns needed, the others stay on disk."""
    return spark.read.schema(SCHEMA).parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the metadata columns alone.

    ``start`` counts the ids of all documents before; only one sum per file is added up in order.
    """
    rows = read(spark, path).select("doc_id", "part", "offset", "n_tokens")
    files = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"),
                                           F.col("n_tokens").cast("long").alias("n_tokens"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all read back from the files."""
    rows = read(spark, path)
    files = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))

    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()),
                 batch.column(3)], names=["doc_id", "offset", "n_tokens", "ids_crc32", "part"])

    seen = rows.select("doc_id", "offset", "ids", "part").mapInArrow(
        sums, "doc_id long, offset long, n_tokens long, ids_crc32 long, part int")
    return seen.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
