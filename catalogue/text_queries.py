"""Normalisation, hashing and word counts over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import (
    PROFILE, SQL_WS, STOP_WORDS, query, spell, sql_bag, sql_full, sql_minimal, sql_spell, texts,
)
from labelloom.functions import text as T


def _digest(df, id_col, col):
    return df.select(id_col, F.md5(col).alias("text_md5"), F.length(col).cast("long").alias("n_chars"))


def _sql_digest(id_col: str, expr: str, source: str) -> str:
    return f"SELECT {id_col}, md5({expr}) AS text_md5, length({expr}) AS n_chars FROM {source}"


@query("text_none", "SELECT doc_id, sha256(coalesce(text, '')) AS raw_sha256, "
       "length(coalesce(text, '')) AS n_chars FROM documents")
def text_none(spark, sf):
    t = T.preprocess("text", "none")
    return texts(spark, sf).select(
        "doc_id", T.raw_hash("text").alias("raw_sha256"), F.length(t).cast("long").alias("n_chars")
    )


@query("text_minimal", f"WITH m AS (SELECT doc_id, {sql_minimal('text')} AS t FROM documents) "
       + _sql_digest("doc_id", "t", "m"))
def text_minimal(spark, sf):
    return _digest(texts(spark, sf).select("doc_id", T.minimal("text").alias("t")), "doc_id", F.col("t"))


@query("text_minimal_arabic", f"WITH m AS (SELECT doc_id, {sql_minimal(sql_spell('text'))} AS t FROM documents) "
       + _sql_digest("doc_id", "t", "m"))
def text_minimal_arabic(spark, sf):
    d = texts(spark, sf).select("doc_id", T.minimal(spell("text")).alias("t"))
    return _digest(d, "doc_id", F.col("t"))


@query("text_bag", f"WITH m AS (SELECT doc_id, {sql_bag('text')} AS t FROM documents) "
       + _sql_digest("doc_id", "t", "m"))
def text_bag(spark, sf):
    d = texts(spark, sf).select("doc_id", T.bag("text", STOP_WORDS).alias("t"))
    return _digest(d, "doc_id", F.col("t"))


@query("text_bag_arabic", f"WITH m AS (SELECT doc_id, {sql_bag(sql_spell('text'))} AS t FROM documents) "
       + _sql_digest("doc_id", "t", "m"))
def text_bag_arabic(spark, sf):
    d = texts(spark, sf).select("doc_id", T.bag(spell("text"), STOP_WORDS).alias("t"))
    return _digest(d, "doc_id", F.col("t"))


@query("text_full", f"WITH {sql_full('documents', 'doc_id', 'text')} " + _sql_digest("doc_id", "t", "norm"))
def text_full(spark, sf):
    d = texts(spark, sf).select("doc_id", T.full("text", PROFILE).alias("t"))
    return _digest(d, "doc_id", F.col("t"))


@query("text_full_arabic", f"WITH {sql_full('documents', 'doc_id', sql_spell('text'), arabic=True)} "
       + _sql_digest("doc_id", "t", "norm"))
def text_full_arabic(spark, sf):
    d = texts(spark, sf).select("doc_id", T.full(spell("text")).alias("t"))
    return _digest(d, "doc_id", F.col("t"))


@query("canonical_uid", f"WITH {sql_full('documents', 'doc_id', 'text')} "
       "SELECT doc_id, sha256(t) AS uid FROM norm")
def canonical_uid(spark, sf):
    return texts(spark, sf).select("doc_id", T.text_id("text", PROFILE).alias("uid"))


@query("canonical_uid_arabic", f"WITH {sql_full('documents', 'doc_id', sql_spell('text'), arabic=True)} "
       "SELECT doc_id, sha256(translate(t, 'یک', 'يك')) AS uid FROM norm")
def canonical_uid_arabic(spark, sf):
    return texts(spark, sf).select("doc_id", T.text_id(spell("text")).alias("uid"))


@query("word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, "
       f"'[{SQL_WS}]+'), lambda w: w <> ''))::INTEGER AS n_words FROM documents")
def word_counts(spark, sf):
    return texts(spark, sf).select("doc_id", T.word_count("text").alias("n_words"))


@query("preprocess_modes", f"""
WITH {sql_full('documents', 'doc_id', 'text')},
modes AS (
  SELECT 'none' AS mode, text AS t FROM documents
  UNION ALL SELECT 'minimal', {sql_minimal('text')} FROM documents
  UNION ALL SELECT 'alg3', t FROM norm
  UNION ALL SELECT 'mhamed', {sql_bag('text')} FROM documents)
SELECT mode, count(*) AS n_texts, count(DISTINCT md5(t)) AS n_distinct,
  count(*) FILTER (WHERE t = '') AS n_empty, sum(length(t))::BIGINT AS n_chars
FROM modes GROUP BY mode""")
def preprocess_modes(spark, sf):
    modes = F.array(*[
        F.struct(F.lit(m).alias("mode"), T.preprocess("text", m, PROFILE, STOP_WORDS).alias("t"))
        for m in ("none", "minimal", "alg3", "mhamed")
    ])
    keyed = texts(spark, sf).select(F.inline(modes)).select(
        "mode", F.md5("t").alias("h"), F.length("t").cast("long").alias("n")
    )
    per_text = keyed.groupBy("mode", "h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return per_text.groupBy("mode").agg(
        F.sum("k").alias("n_texts"), F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("k"))), F.lit(0)).alias("n_empty"),
        F.sum("n").alias("n_chars"),
    )
