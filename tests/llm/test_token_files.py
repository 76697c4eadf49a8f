"""Token files: exact round trip against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelloom.functions.staging import fresh_path
from labelloom.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_are_encoded_as_the_library_does():
    r = random.Random(1)
    letters = "aAbB's.,-!'é—ß1² \tİΣ~<>|`日́\x00\x7f ﻿ʼ"
    encoder = token_files.Encoder(PATH)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += [t + "<|endoftext|>" + t for t in texts[:20]] + ["X<|ENDOFTEXT|>"]
    for text in texts:
        got, n = encoder.chunk([text.encode()])
        assert list(got) == ids(text)[:-1] and n.tolist() == [len(got)], repr(text)
    got, _ = encoder.chunk([t.encode() for t in texts])
    assert list(got) == [i for t in texts for i in ids(t)[:-1]]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder = token_files.Encoder(PATH)
    for text in ("one two three four five", "two six seven eight one"):
        assert list(encoder.chunk([text.encode()])[0]) == ids(text)[:-1]


@pytest.mark.parametrize("partitions", [1, 7])
def test_round_trip_with_nulls_ties_and_clashing_names(spark, partitions):
    rows = [(3, "b a"), (1, "hello  world"), (2, None), (None, "null id"), (3, "a b"), (3, "a b"), (9, ""), (-5, "é" * 3000)]
    docs = spark.createDataFrame([(*r, 7, [1]) for r in rows], "doc_id long, text string, part int, ids array<int>")
    path = fresh_path(spark, "tokens-test")
    token_files.write(docs.repartition(partitions), path, PATH)
    stored = sorted(token_files.read(spark, path).collect(), key=lambda r: (r.part, r.offset))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r.doc_id, r.ids) for r in stored] == [(i, ids(t)) for i, t in want]
    start, expect = 0, []
    for i, t in want:
        own = ids(t)
        expect.append((i, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    got = sorted((tuple(r) for r in token_files.digest(spark, path).collect()), key=lambda r: r[1])
    assert got == expect
    assert sorted((tuple(r) for r in token_files.index(spark, path).collect()), key=lambda r: r[1]) == [e[:3] for e in expect]


def test_files_hold_encoded_lists_and_a_page_index(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, "some words here " * 50) for i in range(300)], "doc_id long, text string")
    path = fresh_path(spark, "tokens-layout")
    token_files.write(docs, path, PATH, row_group=1 << 20, page=4096)
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata
    columns = {c.path_in_schema: c for c in (meta.row_group(0).column(i) for i in range(meta.num_columns))}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_pieces_a_polynomial_hash_confuses_keep_their_ids():
    """Two letters in the Thue-Morse order and its complement: one hash for every odd base, other ids."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "x " + word[::-1], word[:100] + "c" * 600, word[:100] + "c" * 599 + "d"]
    got, counts = token_files.Encoder(PATH).chunk([t.encode() for t in texts])
    assert [x.tolist() + [1] for x in np.split(got, np.cumsum(counts)[:-1])] == [list(ids(t)) for t in texts]


def test_empty_table(spark):
    path = fresh_path(spark, "tokens-none")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_files.digest(spark, path).collect() == []


def test_query_on_the_whole_table(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op3_token_files"](spark, sf_dir).collect()}
    start = 0
    for i, t in rows:
        own = ids(t)
        assert got[i] == (start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        start += len(own)
