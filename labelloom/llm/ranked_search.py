"""Ranked lexical search of all documents for a set of queries: MaxScore with bounds on pairs of terms.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  A term found ``tf`` times in
a document of ``n`` terms adds the impact ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 10 + ((90 * n * N) div L)``.

Method.  1. The index: each document's terms that some query holds, with their counts; one pass over the texts, written to the shared
folder.  Document frequencies, ``N`` and ``L`` come from it.  2. Pair lists: the terms of a query, most frequent first, form a chain, and for
each two neighbours (and each term alone) the list of documents that hold both is intersected; kept are its largest joint impact and its
``k`` best ones.  3. Search: the terms of a query are covered by pairs and single terms so that the sum of their bounds is least (a
pair's bound is its largest joint impact, or the larger term alone, never more than the sum of the two).  Units whose bounds
together stay below the threshold are not essential: only documents that hold a term of another unit are scored, the rest of
their terms is looked up from the largest bound down, and a document is dropped as soon as what is left cannot lift it to the threshold.
The threshold starts at the best k-th joint impact of the query's pairs, known from the whole corpus, and rises with what is found.
Bounds hold for each slice of documents as well (a term's largest impact there), so whole queries are passed over.

Scale.  Queries are a stated set: they are taken in blocks of about ``BLOCK`` bytes of text, each run against all documents, so what the
driver and a worker hold is bounded.  No postings are shuffled: every task searches its own documents and hands
on ``k`` rows a query.  Python workers hold a slice of ``SLICE`` postings at a time and long texts are cut between terms.

Edge cases: null and empty texts, and queries without terms, give no rows; documents that share an id are ranked each;
equal scores go by id, null ids last; repeated queries are searched once and answered each; empty tables give no rows; columns
besides the named ones are not read.  Impacts are 64-bit integers: ``90 * n * N`` has to stay below 2**63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.llm.words import parts

BLOCK = 4 << 20
SLICE = 1 << 20
LONG = 4 << 20
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
#: Bytes of terms stay, all others part them.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text, cut between terms where it is long."""
    at = 0
    while len(text) - at > LONG:
        end = at + LONG
        while end < len(text) and _KEEP[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def split(text: bytes) -> list[bytes]:
    return text.lower().translate(_KEEP).split()


def counts(text: bytes, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms in a text, and the known ones with their counts."""
    n, seen, times = 0, [], []
    for piece in pieces(text):
        found = split(piece)
        n += len(found)
        known = np.fromiter(map(number.get, found, repeat(-1)), dtype=np.int32, count=len(found))
        term, tf = np.unique(known[known >= 0], return_counts=True)
        seen.append(term)
        times.append(tf)
    if len(seen) == 1:
        return n, seen[0], times[0]
    term, place = np.unique(np.concatenate(seen), return_inverse=True)
    tf = np.zeros(len(term), dtype=np.int64)
    np.add.at(tf, place, np.concatenate(times))
    return n, term, tf


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of ``docs`` (id, text): the known terms of each document by number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in parts(batch.column(1)):
                rows = [counts(t, number) for t in texts]
                at = pa.array(np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[i] for r in rows]).astype(np.int32)))
                         for i in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), pa.array([r[0] for r in rows], pa.int64()), *lists],
                    names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Corpus:
    """What impacts depend on: number of documents with terms, all their terms, and weights by term number."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n * self.n_docs) // max(self.n_terms, 1)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def corpus(indexed: DataFrame, size: int) -> tuple[Corpus, np.ndarray]:
    """Statistics over all documents, and the document frequency of each known term."""
    whole = indexed.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(size, dtype=np.int64)
    for r in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a known term
        df[r["term"]] = r["count"]
    weights = [math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return Corpus(whole.docs, whole.terms or 0, np.array(weights, dtype=np.int64).reshape(-1)), df


@dataclass
class Slice:
    """Postings of some documents, by term and then by document."""

    ids: np.ndarray
    null: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    start: np.ndarray

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def largest(self) -> np.ndarray:
        """Largest impact of each term here (0 where it does not occur)."""
        some = np.flatnonzero(np.diff(self.start))
        out = np.zeros(len(self.start) - 1, dtype=np.int64)
        if len(some):
            out[some] = np.maximum.reduceat(self.impact, self.start[some])
        return out


def slices(batches, known: Corpus, size: int) -> Iterator[Slice]:
    """Index rows as postings, about ``size`` at a time."""
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
            own = batch.slice(at, end - at)
            term = own.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = own.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(end - at), sizes[at:end])
            impact = known.impacts(term, tf, own.column(1).to_numpy(zero_copy_only=False)[doc])
            order = np.argsort(term, kind="stable")
            start = np.searchsorted(term[order], np.arange(len(known.weights) + 1))
            yield Slice(own.column(0).fill_null(0).to_numpy(zero_copy_only=False),
                        own.column(0).is_null().to_numpy(zero_copy_only=False), doc[order], impact[order], start)
            at = end


def pair_lists(indexed: DataFrame, known: Corpus, pairs: Sequence[tuple[int, int]], k: int, size: int) -> DataFrame:
    """``pair, joint, floor``: the largest joint impact of each pair of terms (or of a term, paired with itself) over all documents that
    hold both, and the ``k``-th largest (0 where fewer do)."""

    def run(batches):
        import pyarrow as pa

        best = np.zeros((len(pairs), k), dtype=np.int64)
        for part in slices(batches, known, size):
            beside = np.zeros(len(part.ids), dtype=np.int64)
            held = np.diff(part.start) > 0
            for i, (a, b) in enumerate(pairs):
                if not (held[a] and held[b]):
                    continue
                doc, joint = part.of(b)
                if a != b:
                    other, impact = part.of(a)
                    beside[other] = impact + 1  # an impact may be 0
                    both = beside[doc]
                    joint = (joint + both - 1)[both > 0]
                    beside[other] = 0
                if len(joint) and joint.max() > best[i, 0]:
                    top = np.concatenate((best[i], joint))
                    best[i] = -np.sort(-(np.partition(top, len(top) - k)[-k:] if len(top) > k else top))[:k]
        some = np.flatnonzero(best[:, 0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(best[some].tolist(), pa.list_(pa.int64()))],
                                             names=["pair", "best"])

    each = indexed.mapInArrow(run, "pair int, best array<long>").select("pair", F.explode("best").alias("joint"))
    order = Window.partitionBy("pair").orderBy(F.desc("joint"))
    top = each.where("joint > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.groupBy("pair").agg(F.max("joint").alias("joint"),
                                   F.coalesce(F.max(F.when(F.col("place") == k, F.col("joint"))), F.lit(0)).alias("floor"))


@dataclass(frozen=True)
class Query:
    """Units of a query: one or two terms each with an upper bound, least bound first."""

    units: list[tuple[int, ...]]
    bounds: np.ndarray
    floor: int


def cover(chain: Sequence[int], joint: dict[tuple[int, int], int]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Cover of a chain of terms by single terms and neighbouring pairs with the least sum of bounds."""
    single = [joint.get((t, t), 0) for t in chain]
    least, choice = [0], []
    for i, t in enumerate(chain):
        alone = least[i] + single[i]
        if i:
            pair = max(joint.get((chain[i - 1], t), 0), single[i - 1], single[i])
            if least[i - 1] + pair < alone:
                least.append(least[i - 1] + pair)
                choice.append(pair)
                continue
        least.append(alone)
        choice.append(None)
    units, bounds, i = [], [], len(chain)
    while i:
        bound = choice[i - 1]
        size = 1 if bound is None else 2
        units.append(tuple(chain[i - size : i]))
        bounds.append(single[i - 1] if bound is None else bound)
        i -= size
    return units, bounds


def best_of(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id, null ids last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[-k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], null[some], -scores[some]))][:k]


def scored(query: Query, part: Slice, largest: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the slice that may be among the best ``k``, with their exact scores."""
    bounds = np.minimum(query.bounds, [sum(int(largest[t]) for t in unit) for unit in query.units])
    order = np.argsort(bounds, kind="stable")
    reach = np.cumsum(bounds[order])  # what the lowest units can add together
    spare = int(np.searchsorted(reach, floor, side="left"))
    total = np.zeros(len(part.ids), dtype=np.int64)
    for u in order[spare:]:
        for t in query.units[u]:
            doc, impact = part.of(t)
            total[doc] += impact
    docs = np.flatnonzero(total)
    total = total[docs]
    for j in range(spare - 1, -1, -1):
        if len(total) >= k:
            floor = max(floor, int(np.partition(total, len(total) - k)[-k]))
        stay = total + reach[j] >= floor
        docs, total = docs[stay], total[stay]
        if not len(docs):
            break
        for t in query.units[order[j]]:
            doc, impact = part.of(t)
            if len(doc):
                place = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
                total = total + np.where(doc[place] == docs, impact[place], 0)
    stay = total >= floor
    return docs[stay], total[stay]


def matches(indexed: DataFrame, known: Corpus, queries: Sequence[Query], k: int, size: int) -> DataFrame:
    """``query, doc_id, score``: the ``k`` best of each task's documents for every query, fewer where the bounds exclude them."""
    units = [t for q in queries for unit in q.units for t in (unit if len(unit) == 2 else (*unit, *unit))]
    pairs = np.array(units, dtype=np.int64).reshape(-1, 2)
    alone = pairs[:, 0] == pairs[:, 1]
    every = np.concatenate([q.bounds for q in queries]) if queries else np.zeros(0, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum([len(q.units) for q in queries])))[:-1].astype(np.int64)

    def run(batches):
        import pyarrow as pa

        floors = np.array([q.floor for q in queries], dtype=np.int64)
        kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        for part in slices(batches, known, size):
            largest = part.largest()
            here = largest[pairs[:, 0]] + np.where(alone, 0, largest[pairs[:, 1]])
            can = np.add.reduceat(np.minimum(every, here), first)
            for i in np.flatnonzero((can >= floors) & (can > 0)):
                docs, total = scored(queries[i], part, largest, int(floors[i]), k)
                if not len(docs):
                    continue
                own = kept[i]
                merged = [np.concatenate(x) for x in zip(own, (total, part.ids[docs], part.null[docs]), strict=True)]
                best = best_of(*merged, k)
                kept[i] = tuple(x[best] for x in merged)
                if len(best) == k:
                    floors[i] = max(floors[i], int(kept[i][0][-1]))
        n = [len(s) for s, _, _ in kept]
        if sum(n):
            score, ids, null = (np.concatenate(x) for x in zip(*kept, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(queries)), n).astype(np.int32)), pa.array(ids, pa.int64(), mask=null), pa.array(score)],
                names=["query", "doc_id", "score"])

    return indexed.mapInArrow(run, "query int, doc_id long, score long")


def _block(docs: DataFrame, texts: Sequence[str], k: int, size: int) -> DataFrame:
    """``query, rank, doc_id, score`` for a bounded list of query texts."""
    asked = [sorted(set(split(t.encode()))) for t in texts]
    number = {t: i for i, t in enumerate(sorted({t for terms in asked for t in terms}))}
    indexed = stage(index(docs, number), "term-index")
    known, df = corpus(indexed, len(number))
    chains = [sorted((number[t] for t in terms), key=lambda t: (-df[t], t)) for terms in asked]
    pairs = sorted({(t, t) for c in chains for t in c} | {p for c in chains for p in zip(c, c[1:], strict=False)})
    lists = {pairs[r["pair"]]: (r["joint"], r["floor"]) for r in pair_lists(indexed, known, pairs, k, size).collect()}  # one row a pair
    joint = {p: v[0] for p, v in lists.items()}
    queries = []
    for chain in chains:
        units, bounds = cover(chain, joint)
        floor = max((lists[p][1] for p in [*zip(chain, chain, strict=True), *zip(chain, chain[1:], strict=False)] if p in lists), default=0)
        queries.append(Query(units, np.array(bounds, dtype=np.int64), floor))
    held = [i for i, q in enumerate(queries) if q.units]  # a query without terms matches nothing
    found = matches(indexed, known, [queries[i] for i in held], k, size)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    keys = docs.sparkSession.createDataFrame([(n, texts[i]) for n, i in enumerate(held)], "query int, text string")
    return ranked.join(keys, "query").select("text", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, slice_size: int = SLICE) -> DataFrame:
    """``query id, rank, doc_id, score``: the ``k`` best documents of every query; runs jobs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text"))
    texts = items.where("text is not null").select("text").distinct()
    asked = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-asked // block))
    ranked = None
    for b in range(blocks):
        own = [r.text for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text").collect()]
        found = _block(rows, own, k, slice_size)
        ranked = found if ranked is None else ranked.unionByName(found)
    return items.join(ranked, "text").select(F.col("item").alias(query_id), "rank", "doc_id", "score")
