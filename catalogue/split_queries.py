"""Splits, folds and samples of the document table by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import SEED, query, sql_keys, table
from catalogue.dedup_queries import keys
from labelloom.functions.staging import stage
from labelloom.operators import ranking as R
from labelloom.operators import splits as S

LANGS = ["de", "en", "es", "fr"]
SQL_RANKED = """
docs AS (SELECT doc_id, lang, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS code FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS r FROM docs),
cnt AS (SELECT c.code, count(d.doc_id) AS n FROM (VALUES (0), (1), (2), (3)) c(code) LEFT JOIN docs d ON c.code = d.code GROUP BY c.code),
tot AS (SELECT sum(n)::BIGINT AS n_all FROM cnt)"""


def _sql_quota(name: str, source: str, size: str, total: str, draws: str, by: str = "") -> str:
    """Largest remainders, brute force."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
{name}_a AS (SELECT *, ({size} * ({draws})) // {total} AS fl, ({size} * ({draws})) % {total} AS rem, ({draws}) AS dr FROM {source}),
{name} AS (
  SELECT * EXCLUDE (fl, rem, dr),
    fl + CASE WHEN row_number() OVER ({part} ORDER BY rem DESC, code) <= dr - sum(fl) OVER ({part}) THEN 1 ELSE 0 END AS {name}_q
  FROM {name}_a)"""


SQL_SPLIT = SQL_RANKED + ",\nbase AS (SELECT * FROM cnt, tot)," + _sql_quota(
    "k1", "base", "n", "n_all", "n_all - ceil(0.2::DOUBLE * n_all)::BIGINT"
) + """,
aside AS (SELECT *, n - k1_q AS n_aside, sum(n - k1_q) OVER ()::BIGINT AS all_aside FROM k1),""" + _sql_quota(
    "k2", "aside", "n_aside", "all_aside", "all_aside - ceil(0.5::DOUBLE * all_aside)::BIGINT"
) + """,
split AS (
  SELECT doc_id, lang, CASE WHEN r <= n_aside - k2_q THEN 'test' WHEN r <= n_aside THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN k2 USING (code))"""

SQL_NESTED = SQL_RANKED + ",\nbase AS (SELECT * FROM cnt, tot)," + _sql_quota(
    "k1", "base", "n", "n_all", "n_all - ceil(0.2::DOUBLE * n_all)::BIGINT"
) + """,
rest AS (SELECT *, sum(k1_q) OVER ()::BIGINT AS all_rest FROM k1),""" + _sql_quota(
    "k2", "rest", "k1_q", "all_rest", "all_rest - ceil(0.1::DOUBLE * all_rest)::BIGINT"
) + """,
split AS (
  SELECT doc_id, lang, CASE WHEN r <= n - k1_q THEN 'test' WHEN r <= n - k2_q THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN k2 USING (code))"""

SQL_FOLDS = SQL_RANKED + """,
off AS (SELECT code, n, (sum(n) OVER (ORDER BY code) - n)::BIGINT AS o FROM cnt),
dealt AS (SELECT doc_id, lang, code, r, ((o + r - 1) % 10)::INTEGER AS fold FROM ranked JOIN off USING (code)),
every AS (SELECT d.*, f.f FROM dealt d, (SELECT unnest(range(0, 10)) AS f) f),
remain AS (
  SELECT *, row_number() OVER (PARTITION BY f, code ORDER BY r) - 1 AS place,
    count(*) OVER (PARTITION BY f, code) AS rest_n, count(*) OVER (PARTITION BY f) AS all_rest
  FROM every WHERE fold <> f),
fq AS (SELECT DISTINCT f, code, rest_n, all_rest FROM remain),""" + _sql_quota(
    "fv", "fq", "rest_n", "all_rest", "all_rest - ceil((1.0::DOUBLE / 9.0) * all_rest)::BIGINT", "f"
) + """,
member AS (
  SELECT m.f::INTEGER AS fold,
    CASE WHEN (m.place - (m.f * m.rest_n) // 10 + m.rest_n) % m.rest_n < m.rest_n - v.fv_q THEN 'val' ELSE 'train' END AS part,
    m.doc_id, m.lang
  FROM remain m JOIN fv v ON m.f = v.f AND m.code = v.code
  UNION ALL SELECT fold, 'test', doc_id, lang FROM dealt)"""

SQL_GROUP_FOLDS = sql_keys("documents", "doc_id", extra="s.lang") + """,
gl AS (SELECT uid, lang, count(*) AS k FROM keys GROUP BY uid, lang),
gr AS (
  SELECT uid, sum(k)::BIGINT AS n_rows,
    arg_max(list_position(['de', 'en', 'es', 'fr'], lang) - 1, k * 10 - list_position(['de', 'en', 'es', 'fr'], lang)) AS code
  FROM gl GROUP BY uid),
pl AS (SELECT uid, code, n_rows,
  row_number() OVER (PARTITION BY code ORDER BY n_rows DESC, md5(concat(uid, ':42')), uid) - 1 AS place FROM gr),
gf AS (SELECT *, (CASE WHEN place % 20 < 10 THEN place % 20 ELSE 19 - place % 20 END)::INTEGER AS fold FROM pl),
rest AS (
  SELECT g.uid, g.fold, f.f, row_number() OVER (PARTITION BY f.f, g.code ORDER BY g.place) - 1 AS p
  FROM gf g, (SELECT unnest(range(0, 10)) AS f) f WHERE g.fold <> f.f),
gm AS (
  SELECT f::INTEGER AS fold, CASE WHEN (p + f) % 18 IN (0, 17) THEN 'val' ELSE 'train' END AS part, uid FROM rest
  UNION ALL SELECT fold, 'test', uid FROM gf),
member AS (SELECT m.fold, m.part, k.doc_id, k.lang, k.uid FROM gm m JOIN keys k USING (uid))"""


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


def kfold(spark, sf):
    return S.stratified_kfold(documents(spark, sf), "doc_id", "lang", LANGS, SEED)


def group_kfold(spark, sf):
    by_key = stage(keys(spark, sf, ("lang",)).select("doc_id", "uid", "lang"), "keys")
    return S.stratified_group_kfold(by_key, "doc_id", "uid", "lang", LANGS, SEED)


@query("stratified_split", f"WITH {SQL_SPLIT} SELECT * FROM split")
def stratified_split(spark, sf):
    return S.stratified_split(documents(spark, sf), "doc_id", "lang", LANGS, SEED)


@query("nested_split", f"WITH {SQL_NESTED} SELECT * FROM split")
def nested_split(spark, sf):
    return S.nested_split(documents(spark, sf), "doc_id", "lang", LANGS, SEED)


@query("split_report", f"WITH {SQL_SPLIT} SELECT split, lang, count(*) AS n FROM split GROUP BY split, lang")
def split_report(spark, sf):
    return S.split_report(stratified_split(spark, sf), "split", "lang")


@query("kfold_membership", f"WITH {SQL_FOLDS} SELECT fold, part, doc_id FROM member")
def kfold_membership(spark, sf):
    return S.fold_membership(kfold(spark, sf), "doc_id")


@query("fold_subset", f"WITH {SQL_FOLDS} SELECT fold, part, doc_id FROM member WHERE fold IN (0, 3)")
def fold_subset(spark, sf):
    return S.fold_membership(kfold(spark, sf), "doc_id", only=[0, 3])


@query("fold_report", f"WITH {SQL_FOLDS} SELECT fold, part, lang, count(*) AS n FROM member GROUP BY ALL")
def fold_report(spark, sf):
    return S.fold_report(kfold(spark, sf), "lang")


@query("group_kfold", f"WITH {SQL_GROUP_FOLDS} SELECT fold, part, doc_id FROM member")
def group_kfold_membership(spark, sf):
    return S.fold_membership(group_kfold(spark, sf), "doc_id")


@query("group_kfold_straddle", f"""WITH {SQL_GROUP_FOLDS},
g AS (SELECT fold, uid, count(DISTINCT part) AS k FROM member GROUP BY fold, uid)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE k > 1) AS straddling FROM g""")
def group_kfold_straddle(spark, sf):
    """No group may sit in two parts of one fold: roles are compared per group."""
    roles = S.fold_membership(group_kfold(spark, sf), "uid")
    return (
        roles.withColumn("bit", F.when(F.col("part") == "train", 1).when(F.col("part") == "val", 2).otherwise(4))
        .groupBy("uid", "fold").agg((F.bit_count(F.bit_or("bit")) > 1).alias("bad"))
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("bad").alias("straddling"))
    )


@query("fold_partition_check", """
SELECT count(*) AS n_keys, 0::BIGINT AS never_tested, 0::BIGINT AS tested_twice, 0::BIGINT AS repeated_keys,
  0::BIGINT AS wrong_length FROM documents""")
def fold_partition_check(spark, sf):
    return S.fold_partition_check(kfold(spark, sf), "doc_id", 10)


@query("stratified_sample", f"""WITH {SQL_RANKED}
SELECT doc_id, lang FROM ranked WHERE r <= greatest(1, 200 // 4)""")
def stratified_sample(spark, sf):
    return S.stratified_sample(documents(spark, sf), "doc_id", "lang", LANGS, 200, SEED)


@query("head_per_split", f"""WITH {SQL_SPLIT},
h AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS k FROM split)
SELECT doc_id, lang, split FROM h
WHERE k <= CASE split WHEN 'train' THEN 48 ELSE 32 END""")
def head_per_split(spark, sf):
    return S.head_per_split(stratified_split(spark, sf), "split", F.col("doc_id"), {"train": 48, "val": 32, "test": 32})


@query("exact_rank", """
SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents""")
def exact_rank(spark, sf):
    """Rank by length inside the language, in ranges cut by the data."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return R.range_rank(d, ["lang"], [F.desc("n_chars"), F.col("doc_id").asc()], name="place").select("doc_id", "place")


@query("source_numbers", """
SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS source_no,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS n_rows
FROM documents""")
def source_numbers(spark, sf):
    """Position inside the source, size and number of the source, from one dealing of the rows."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    ranked = R.range_rank(d, ["source"], [F.col("doc_id").asc()], name="place", total="n_rows", group_no="source_no")
    return ranked.select("doc_id", "source_no", "place", "n_rows")
