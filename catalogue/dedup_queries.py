"""De-duplication by canonical key, conflict policy, collisions between corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import PROFILE, STOP_WORDS, query, sql_bag, sql_keys, texts
from labelloom.functions.text import bag
from labelloom.operators import dedup as D

SOURCES = [f"src{i}" for i in range(20)]
SQL_KEYS = sql_keys("documents", "doc_id", extra="s.source, s.lang, s.text")
SQL_GROUPS = """
grp AS (
  SELECT uid, count(*) AS n_rows, min(doc_id) AS doc_id, count(DISTINCT source) > 1 AS conflict
  FROM keys WHERE NOT is_empty GROUP BY uid)"""


def keys(spark, sf, extra=("source",)):
    return D.text_keys(texts(spark, sf), "text", ["doc_id", *extra], PROFILE)


@query("text_keys", f"WITH {SQL_KEYS} SELECT doc_id, source, uid, raw_sha256, is_empty FROM keys")
def text_keys(spark, sf):
    return keys(spark, sf)


@query("canonical_groups", f"WITH {SQL_KEYS}, {SQL_GROUPS} SELECT * FROM grp")
def canonical_groups(spark, sf):
    return D.canonical_groups(keys(spark, sf), "source", "doc_id", SOURCES)


@query("dedup_keep", f"""WITH {SQL_KEYS}, {SQL_GROUPS}
SELECT d.doc_id, g.uid, d.source, d.lang, md5(d.text) AS text_md5
FROM documents d JOIN grp g ON d.doc_id = g.doc_id WHERE NOT g.conflict""")
def dedup_keep(spark, sf):
    kept = D.deduplicate(texts(spark, sf), "text", "source", "doc_id", SOURCES, PROFILE)
    return kept.select("doc_id", "uid", "source", "lang", F.md5("text").alias("text_md5"))


def _sql_report(label: str) -> str:
    return f"""WITH {SQL_KEYS},
raw AS (SELECT raw_sha256, count(*) AS n, count(DISTINCT {label}) AS k FROM keys GROUP BY raw_sha256),
can AS (SELECT uid, count(*) AS n, count(DISTINCT {label}) AS k FROM keys WHERE NOT is_empty GROUP BY uid)
SELECT (SELECT count(*) FROM keys) AS rows_in,
  (SELECT count(*) FROM keys WHERE is_empty) AS empty_after_canonicalisation,
  (SELECT sum(n - 1)::BIGINT FROM raw) AS exact_raw_duplicate_rows_beyond_first,
  (SELECT count(*) FROM raw WHERE n > 1) AS exact_raw_duplicate_groups,
  (SELECT count(*) FROM raw WHERE k > 1) AS exact_raw_groups_with_label_conflict,
  (SELECT count(*) FROM can) AS canonical_groups,
  (SELECT count(*) FROM can WHERE n > 1) AS canonical_groups_size_gt1,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM can WHERE n > 1) AS rows_in_canonical_groups_size_gt1,
  (SELECT count(*) FROM can WHERE k > 1) AS canonical_groups_with_label_conflict,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM can WHERE k > 1) AS rows_in_conflicting_groups,
  (SELECT count(*) FROM can WHERE k = 1) AS rows_out,
  (SELECT count(*) FROM keys) - (SELECT count(*) FROM can WHERE k = 1) AS rows_removed_total"""


@query("dedup_report", _sql_report("source"))
def dedup_report(spark, sf):
    return D.dedup_report(keys(spark, sf), "source", SOURCES)


@query("dedup_binary_view", _sql_report("(source IN ('src0', 'src1', 'src2', 'src3', 'src4'))"))
def dedup_binary_view(spark, sf):
    """The same report after coarsening the label to two classes."""
    coarse = F.when(F.col("source").isin(SOURCES[:5]), "head").otherwise("tail")
    return D.dedup_report(keys(spark, sf).withColumn("source", coarse), "source", ["head", "tail"])


FIRST, SECOND = SOURCES[:10], SOURCES[10:]
SQL_DIGIT = "substr(md5(concat(CAST({c}doc_id AS VARCHAR), ':42')), 1, 1)"
SQL_TWO = f"""WITH {SQL_KEYS},
other AS (
  SELECT uid, max(CASE WHEN {SQL_DIGIT.format(c='')} < '4' THEN 1 ELSE 0 END) AS held
  FROM keys WHERE source IN ({', '.join(repr(x) for x in SECOND)}) GROUP BY uid),
flags AS (
  SELECT k.doc_id, k.uid, CASE WHEN {SQL_DIGIT.format(c='k.')} < '2' THEN 'test' ELSE 'train' END AS split,
    (o.uid IS NOT NULL)::INTEGER AS collides_any, coalesce(o.held, 0)::INTEGER AS exclude
  FROM keys k LEFT JOIN other o ON k.uid = o.uid WHERE k.source IN ({', '.join(repr(x) for x in FIRST)}))"""


def flagged(spark, sf):
    """Documents of the first ten sources are one corpus, those of the others the second."""
    digit = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), 1, 1)
    k = keys(spark, sf)
    mine = k.filter(F.col("source").isin(FIRST)).select(
        "doc_id", "uid", F.when(digit < "2", "test").otherwise("train").alias("split")
    )
    other = k.filter(F.col("source").isin(SECOND)).select("uid", (digit < "4").alias("held"))
    return D.collision_flags(mine, other, F.col("held")), other


@query("cross_corpus_flags", SQL_TWO + " SELECT * FROM flags")
def cross_corpus_flags(spark, sf):
    return flagged(spark, sf)[0]


@query("aux_filtered", SQL_TWO + " SELECT * FROM flags WHERE split = 'train' AND exclude = 0")
def aux_filtered(spark, sf):
    return D.drop_excluded(flagged(spark, sf)[0])


@query("aux_overlap", SQL_TWO + """
SELECT count(DISTINCT f.uid) AS n_shared FROM flags f JOIN keys k ON f.uid = k.uid
WHERE f.split = 'train' AND f.exclude = 0 AND k.source IN (""" + ", ".join(repr(x) for x in SECOND) + ")")
def aux_overlap(spark, sf):
    flags, other = flagged(spark, sf)
    return D.overlap_count(D.drop_excluded(flags), other)


@query("lossy_groups", f"""
WITH b AS (SELECT doc_id, source, {sql_bag('text')} AS t FROM documents),
g AS (SELECT sha256(t) AS h, count(*) AS n, count(DISTINCT source) AS k, count(*) FILTER (WHERE t = '') AS e FROM b GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS groups_size_gt1,
  coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in_groups_size_gt1, max(n) AS largest_group,
  count(*) FILTER (WHERE k > 1) AS groups_with_mixed_labels, sum(e)::BIGINT AS rows_with_empty_input FROM g""")
def lossy_groups(spark, sf):
    d = texts(spark, sf).select("source", bag("text", STOP_WORDS).alias("t"))
    return D.lossy_groups(d, F.sha2("t", 256), "source", F.col("t") == "", SOURCES)
