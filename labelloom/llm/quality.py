"""Quality classifier: supervised subword embeddings.

Method.  Words, word pairs and runs of three and four bytes of a text are hashed into ``2 ** bits`` buckets.
Every bucket has a learned vector; a document is the mean of its features' vectors (each of the
four kinds weighs the same), followed by a softmax over the two labels.  Vectors and output layer are trained by stochastic gradient
descent in NumPy in one task, from the bucket counts of at most ``max_rows`` labelled
documents, the first by a hash of their id.  Only that sample is bounded; every text is
scored whole.

Scoring uses that the network is linear up to the softmax: the difference of the two outputs is
the mean of one number per bucket, so executors receive ``2 ** bits`` floats.

A pair of equal neighbouring words has a bucket of its own, whatever the word, so that stuttering
text is seen.

Edge cases: null and empty texts have no features and get the score of the bias alone; labels
that are null or contradict each other for one id are not learned from; without labels of both
kinds every score is the share of label 1 (0.5 without any); repeated rows are scored alike; null
ids are scored but never learned from; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.words import chunks, mix, parts

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RUNS = (3, 4)


def held_out(id_col: Column) -> Column:
    """The remainder of the id's crc32 by 4 is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _runs(data: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Bucket of the run of ``length`` bytes that starts at each byte."""
    n = max(len(data) - length + 1, 0)
    h = np.full(n, np.uint64(length), dtype=np.uint64)
    for j in range(length):
        h = h * np.uint64(257) + data[j : j + n]
    return ((h * _A) >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[bytes], bits: int):
    """Yield ``(first, last + 1, [(buckets, offsets of the texts), ...])`` for runs of whole texts."""
    for first, last, words, bounds in chunks(texts):
        shift = np.uint64(64 - bits)
        kinds = [(((words * _B) >> shift).astype(np.int64), bounds)]
        pair = mix(words[:-1] * _A + words[1:])
        pair[words[:-1] == words[1:]] = np.uint64(0)
        counts = np.diff(bounds)
        keep = np.ones(len(pair), dtype=bool)
        ends = bounds[1:] - 1
        keep[ends[(ends >= 0) & (ends < len(pair))]] = False  # pairs across two texts
        kinds.append((((pair[keep] * _B) >> shift).astype(np.int64),
                      np.concatenate(([0], np.cumsum(np.maximum(counts - 1, 0))))))
        sizes = np.array([len(t) for t in texts[first:last]], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)))
        for length in RUNS:
            room = np.maximum(sizes - length + 1, 0)
            starts = np.concatenate(([0], np.cumsum(room)))
            place = np.arange(starts[-1]) + np.repeat(at[:-1] - starts[:-1], room)
            kinds.append((_runs(data, length, bits)[place] if len(place) else place, starts))
        yield first, last, kinds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def logits(texts: list[bytes], scores: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of label 1 for each text."""
    bits = int(len(scores)).bit_length() - 1
    out = np.full(len(texts), bias)
    for first, last, kinds in features(texts, bits):
        for buckets, bounds in kinds:
            out[first:last] += _sums(scores[buckets], bounds) / np.maximum(np.diff(bounds), 1) / len(kinds)
    return out


@dataclass
class Model:
    scores: np.ndarray  # one float32 per bucket
    bias: float


def counted(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their weights in its mean."""
    out = []
    for _, _, kinds in features(texts, bits):
        for i in range(len(kinds[0][1]) - 1):
            own = [b[bounds[i] : bounds[i + 1]] for b, bounds in kinds]
            share = np.concatenate([np.full(len(o), 1 / max(len(o), 1) / len(kinds)) for o in own])
            ids, place = np.unique(np.concatenate(own), return_inverse=True)
            out.append((ids.astype(np.int32), np.bincount(place, share, len(ids)).astype(np.float32)))
    return out


def packed(ids: np.ndarray, weights: np.ndarray) -> bytes:
    """A text's ascending buckets (as steps) and their weights, compressed: about a fifth of the arrays."""
    import pyarrow as pa

    steps = np.diff(ids, prepend=np.int32(0)).astype("<i4")
    return pa.compress(steps.tobytes() + weights.astype("<f4").tobytes(), codec="zstd", asbytes=True)


class Packed:
    """Rows of :func:`packed` cells of known lengths, unpacked where they are read."""

    def __init__(self, cells: list[bytes], sizes: np.ndarray):
        self.cells, self.sizes = cells, sizes

    def __len__(self) -> int:
        return len(self.cells)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        n = int(self.sizes[i])  # an IndexError beyond the last row ends an iteration
        data = pa.decompress(self.cells[i], 8 * n, codec="zstd", asbytes=True)
        return np.cumsum(np.frombuffer(data, dtype="<i4", count=n), dtype=np.int32), np.frombuffer(data, dtype="<f4", offset=4 * n)


def train(rows: list[tuple[np.ndarray, np.ndarray]] | Packed, labels: np.ndarray, *, bits: int, dim: int, epochs: int,
          rate: float, batch: int, seed: int) -> Model:
    """Stochastic gradient descent on the mean vector's softmax loss (AdaGrad step sizes)."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(1 << bits, dtype=np.float32), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, offset = np.zeros((dim, 2), dtype=np.float64), np.array([0.0, bias])
    layer += rng.normal(0, 0.5, layer.shape)
    seen_v, seen_l, seen_o = np.full(1 << bits, 1e-8, dtype=np.float32), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            own_rows = [rows[i] for i in pick]
            sizes = np.array([len(ids) for ids, _ in own_rows])
            pick, sizes = pick[sizes > 0], sizes[sizes > 0]
            if not len(pick):
                continue
            ids = np.concatenate([ids for ids, _ in own_rows])
            weight = np.concatenate([w for _, w in own_rows])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hidden = np.add.reduceat(vectors[ids] * weight[:, None], starts).astype(np.float64)
            out = hidden @ layer + offset
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = out / out.sum(axis=1, keepdims=True)
            error[np.arange(len(pick)), labels[pick]] -= 1
            grad_l, grad_o = hidden.T @ error / len(pick), error.mean(axis=0)
            back = (error @ layer.T).astype(np.float32)
            sort = np.argsort(ids, kind="stable")
            own, first = np.unique(ids[sort], return_index=True)
            grad_v = np.add.reduceat((back[np.repeat(np.arange(len(pick)), sizes)] * weight[:, None])[sort], first)
            seen_v[own] += (grad_v * grad_v).mean(axis=1)
            vectors[own] -= rate * grad_v / np.sqrt(seen_v[own])[:, None]
            seen_l += grad_l * grad_l
            layer -= rate * grad_l / np.sqrt(seen_l)
            seen_o += grad_o * grad_o
            offset -= rate * grad_o / np.sqrt(seen_o)
    difference = layer[:, 1] - layer[:, 0]
    return Model((vectors @ difference.astype(np.float32)), float(offset[1] - offset[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = 4000, bits: int = 17, dim: int = 8, epochs: int = 6,
        rate: float = 0.5, batch: int = 32, seed: int = 1) -> Model:
    """Learn from at most ``max_rows`` labelled documents that are not held out."""
    key = F.col(id_col)
    known = labels.where(key.isNotNull() & ~held_out(key)).groupBy(key.alias("doc_id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    known = known.where("low = high and low in (0, 1)").select("doc_id", F.col("low").cast("int").alias("label"))
    # The sample is ordered after the join, so labels without a document take no place in it.
    present = docs.select(key.alias("doc_id")).distinct().join(known, "doc_id")
    sample = present.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    chosen = docs.select(key.alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(packed(*row), len(row[0])) for _, texts in parts(b.column(2)) for row in counted(texts, bits)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[0] for r in rows], pa.binary())], names=["doc_id", "label", "size", "features"])

    def learn(batches):
        import pyarrow as pa

        # Compressed until a step of the training needs them, so the sample takes a fraction of its arrays.
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda row: row[0])
        cells = Packed([row[3] for row in rows], np.array([row[2] for row in rows], dtype=np.int64))
        known_labels = np.array([row[1] for row in rows], dtype=np.int64)
        model = train(cells, known_labels, bits=bits, dim=dim, epochs=epochs, rate=rate, batch=batch, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias])], names=["scores", "bias"])

    # The sample is bounded, so one task learns; the driver gets a number for each bucket.
    counts = chosen.mapInArrow(count, "doc_id long, label int, size int, features binary")
    made = counts.repartition(1).mapInArrow(learn, "scores binary, bias double").first()
    return Model(np.frombuffer(made["scores"], dtype=np.float32), made["bias"])


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for every whole text."""
    scores, bias = model.scores, model.bias

    @F.arrow_udf("double")
    def probability(column):
        import pyarrow as pa

        odds = [logits(texts, scores, bias) for _, texts in parts(column)]
        return pa.array(1 / (1 + np.exp(-np.concatenate(odds)))) if odds else pa.array([], pa.float64())

    return probability(text)
