"""Round trips through the file formats, pooled ids, re-attached labels, the frozen manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import PROFILE, SQL_PREDICTIONS, STOP_WORDS, predictions, query, table, texts
from catalogue.consensus_queries import SQL_RESOLVED, annotators
from catalogue.dedup_queries import SOURCES, SQL_GROUPS, SQL_KEYS
from catalogue.explanation_queries import SQL_ATTR, attributions
from catalogue.integrity_queries import _DIGEST, _sql_fp
from catalogue.split_queries import LANGS, SQL_FOLDS, SQL_NESTED, _sql_quota, kfold
from catalogue.weak_queries import SQL_VOTES, TERMS, _sql_weighted, _sql_weights
from labelloom.functions.staging import fresh_path as fresh
from labelloom.functions.staging import stage
from labelloom.operators import attribution as X
from labelloom.operators import consensus as C
from labelloom.operators import dedup as D
from labelloom.operators import splits as S
from labelloom.plans import corpus_freeze as CF
from labelloom.plans import task_loader as TL
from labelloom.sources import corpora as Src
from labelloom.sources import tables as Tab


@query("tsv_round_trip", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, md5(regexp_replace(text, '[\t\n\r]', ' ', 'g')) AS text_md5, lang, source,
  '' AS human_verified FROM documents""")
def tsv_round_trip(spark, sf):
    d = texts(spark, sf).select(
        F.col("doc_id").alias("id"), "text", "lang", "source", F.lit(None).cast("string").alias("human_verified")
    )
    path = fresh(spark, "tsv")
    Src.write_tsv(d, path)
    back = Src.read_tsv(spark, path, d.columns)
    return back.select("id", F.md5("text").alias("text_md5"), "lang", "source", "human_verified")


@query("manifest_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def manifest_round_trip(spark, sf):
    d = texts(spark, sf).select("doc_id", "text", "lang")
    path = fresh(spark, "manifest")
    Src.write_manifest_tsv(d, path)
    back = Src.read_manifest_tsv(spark, path, d.columns)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("json_round_trip", "SELECT doc_id AS row_no, md5(text) AS text_md5, source, lang AS keyword_category FROM documents")
def json_round_trip(spark, sf):
    d = texts(spark, sf).select(
        F.col("doc_id").alias("row_no"), "text", "source", F.col("lang").alias("keyword_category")
    )
    path = fresh(spark, "json")
    d.write.json(path)
    back = Src.read_json_lines(spark, path, d.schema)
    return back.select("row_no", F.md5("text").alias("text_md5"), "source", "keyword_category")


@query("pooled_ids", """
WITH p AS (SELECT 0 AS f, 'documents.json' AS src_file, doc_id AS row_no FROM documents
  UNION ALL SELECT 1, 'benchmark.json', item_id FROM benchmark
  UNION ALL SELECT 2, 'conversations.json', conv_id * 1000 + turn FROM conversations)
SELECT src_file, row_no, row_number() OVER (ORDER BY f, row_no) AS id FROM p""")
def pooled_ids(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_no"))
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_no"))
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"))
    return Src.pool([("in/documents.json", docs), ("in/benchmark.json", bench), ("in/conversations.json", conv)])


SQL_PUBLISHED = f"WITH {SQL_KEYS}, {SQL_GROUPS}, pub AS (SELECT uid, min(lang) AS label FROM keys JOIN grp USING (uid) WHERE NOT grp.conflict GROUP BY uid)"


def published(spark, sf):
    """Ids and labels as they would be published: no texts, one row per key."""
    keys = D.text_keys(texts(spark, sf), "text", ["doc_id", "source", "lang"], PROFILE)
    kept = D.kept_rows(keys, "source", "doc_id", SOURCES)
    return kept.join(keys.groupBy("uid").agg(F.min("lang").alias("label")), "uid").select("uid", "label")


@query("reattach_labels", SQL_PUBLISHED + """
SELECT k.doc_id, k.uid, p.label FROM keys k JOIN pub p USING (uid)""")
def reattach_labels(spark, sf):
    held = texts(spark, sf).select("doc_id", "text")
    matched, _ = Src.reattach(held, "text", published(spark, sf), PROFILE)
    return matched.select("doc_id", "uid", "label")


@query("reattach_missing", SQL_PUBLISHED + """
SELECT p.uid, p.label FROM pub p WHERE p.uid NOT IN (SELECT uid FROM keys WHERE lang <> 'fr')""")
def reattach_missing(spark, sf):
    """Published ids whose text the holder lacks (here: a holder without the French texts)."""
    held = texts(spark, sf).filter(F.col("lang") != "fr").select("doc_id", "text")
    _, missing = Src.reattach(held, "text", published(spark, sf), PROFILE)
    return missing


def _stored_predictions(spark, sf):
    p = predictions(spark, sf).select(
        "system", "seed", F.lit(0).alias("fold"), F.col("uid").cast("string").alias("uid"), "y",
        F.transform("probs", lambda v: F.ln(v).cast("float")).alias("logits"),
        F.transform("probs", lambda v: v.cast("float")).alias("probs"), F.lit("three").alias("task"), "split",
    )
    path = fresh(spark, "predictions")
    Tab.write_predictions(p, path)
    return path


_SCORES = ", ".join(f"round(p{c}, 5) AS p{c}, round(ln(p{c}), 4) AS l{c}" for c in range(3))


def _score_columns():
    return [F.round(F.get(a, F.lit(c)).cast("double"), d).alias(f"{n}{c}")
            for c in range(3) for a, d, n in (("probs", 5, "p"), ("logits", 4, "l"))]


@query("predictions_round_trip", f"""WITH {SQL_PREDICTIONS}
SELECT system, seed, 0 AS fold, CAST(uid AS VARCHAR) AS uid, y, 'three' AS task, split, {_SCORES} FROM preds""")
def predictions_round_trip(spark, sf):
    back = Tab.read_predictions(spark, _stored_predictions(spark, sf))
    return back.select("system", "seed", "fold", "uid", "y", "task", "split", *_score_columns())


@query("predictions_one_split", f"""WITH {SQL_PREDICTIONS}
SELECT system, seed, CAST(uid AS VARCHAR) AS uid, y, {_SCORES} FROM preds WHERE split = 'val'""")
def predictions_one_split(spark, sf):
    """The pruned read of the same table: only the folder of one task and split is opened."""
    back = Tab.read_predictions(spark, _stored_predictions(spark, sf), task="three", split="val")
    return back.select("system", "seed", "uid", "y", *_score_columns())


@query("membership_round_trip", f"""WITH {SQL_FOLDS}
SELECT fold, part, CAST(doc_id AS VARCHAR) AS uid FROM member""")
def membership_round_trip(spark, sf):
    long = S.fold_membership(kfold(spark, sf), "doc_id").withColumnRenamed("doc_id", "uid")
    path = fresh(spark, "folds")
    Tab.write_membership(long.withColumn("uid", F.col("uid").cast("string")), path)
    return Tab.read_membership(spark, path)


@query("csv_export", f"""WITH {SQL_ATTR},
g AS (SELECT cls, token, round(avg(value), 12) AS m, count(*) AS n FROM attr GROUP BY cls, token HAVING count(*) >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY m DESC, token) AS r FROM g)
SELECT cls::INTEGER AS cls, token, round(m, 9) AS mean_value, n AS "count" FROM k WHERE r <= 30""")
def csv_export(spark, sf):
    top = X.class_importance(attributions(spark, sf)).select("cls", "token", "mean_value", "count")
    path = fresh(spark, "csv")
    Tab.write_csv(top, path)
    return spark.read.schema(top.schema).csv(path, header=True).withColumn("mean_value", F.round("mean_value", 9))


def _sql_all_digests(tables):
    rows = ", ".join(f"fp_{t} AS (SELECT {_sql_fp(c)} AS fp FROM {t})" for t, c in tables.items())
    return rows + " " + " UNION ALL ".join(f"SELECT '{t}' AS name, {_DIGEST} FROM fp_{t}" for t in tables)


@query("json_array_round_trip", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, md5(text) AS text_md5, source, lang AS keyword_category FROM documents""")
def json_array_round_trip(spark, sf):
    """The documents as JSON arrays, each file read in ranges of a quarter megabyte by as many tasks."""
    d = texts(spark, sf).select("doc_id", "text", "source", F.col("lang").alias("keyword_category")).sortWithinPartitions("doc_id")
    path = fresh(spark, "json-array")
    Src.write_json_array(d, path)
    back = Src.read_json_array(spark, path, d.schema, split=1 << 18)
    return back.select("row_no", "doc_id", F.md5("text").alias("text_md5"), "source", "keyword_category")


@query("dataset_added", f"""WITH {_sql_all_digests({'benchmark': ['item_id', 'text'], 'documents': ['doc_id', 'lang', 'n_chars', 'source', 'text']})}""")
def dataset_added(spark, sf):
    """A further table stored beside a frozen one, whose digest was stored when it was frozen: the digests of both."""
    frozen = {"documents": f"{sf}/documents.parquet"}
    recorded = stage(Tab.table_digests(spark, frozen), "digests")
    return Tab.add_dataset(frozen, recorded, "benchmark", table(spark, sf, "benchmark"), fresh(spark, "benchmark"))


# ---------------------------------------------------------------------- the whole build
def annotated(spark, sf):
    """Labelled documents with three annotators, as the build expects them."""
    a = C.consensus(annotators(spark, sf), ("ws_label", "gpt_label", "llama_label"), "gpt_label")
    docs = texts(spark, sf).select("doc_id", "text", "source", F.col("lang").alias("keyword_cat"))
    return docs.join(a, "doc_id").withColumnRenamed("doc_id", "id")


PLAN = CF.CorpusPlan(lexicons=TERMS, profile=PROFILE, stop_words=STOP_WORDS)

SQL_FREEZE_KEYS = f"""WITH {SQL_RESOLVED}, {SQL_KEYS},
lk AS (SELECT k.*, r.final_label FROM keys k JOIN resolved r USING (doc_id)),
keepers AS (SELECT uid, min(doc_id) AS doc_id FROM lk WHERE NOT is_empty GROUP BY uid HAVING count(DISTINCT final_label) = 1)"""


@query("frozen_manifest", SQL_FREEZE_KEYS + """,
numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS orig_row FROM resolved JOIN documents USING (doc_id))
SELECT r.doc_id AS orig_id, orig_row, p.uid, r.final_label AS label3_v1,
  CASE WHEN r.final_label = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'HARMFUL' END AS labelb_v1, r.ws_label AS ws_v1, r.gpt_label, r.llama_label,
  r.method AS method_v1, d.source, d.lang AS keyword_cat, lk.raw_sha256, md5(d.text) AS text_md5
FROM keepers p JOIN resolved r USING (doc_id) JOIN lk USING (doc_id) JOIN documents d USING (doc_id) JOIN numbered USING (doc_id)""")
def frozen_manifest(spark, sf):
    """Columns of the frozen manifest that do not depend on the split."""
    m = CF.freeze_corpus(annotated(spark, sf), PLAN)["manifest"]
    return m.select("orig_id", "orig_row", "uid", "label3_v1", "labelb_v1", "ws_v1", "gpt_label", "llama_label", "method_v1", "source",
                    "keyword_cat", "raw_sha256", F.md5("text").alias("text_md5"))


SQL_FREEZE_LABELS = SQL_FREEZE_KEYS + f""",
kdocs AS (
  SELECT p.doc_id, p.uid, list_position(['HATE', 'OFFENSIVE', 'NEUTRAL'], r.final_label) - 1 AS code
  FROM keepers p JOIN resolved r USING (doc_id)),
kranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5(concat(uid, ':42')), uid) AS r FROM kdocs),
kcnt AS (SELECT c.code, count(d.doc_id) AS n FROM (VALUES (0), (1), (2)) c(code) LEFT JOIN kdocs d ON c.code = d.code GROUP BY c.code),
ktot AS (SELECT sum(n)::BIGINT AS n_all FROM kcnt),
base AS (SELECT * FROM kcnt, ktot),""" + _sql_quota(
    "k1", "base", "n", "n_all", "n_all - ceil(0.2::DOUBLE * n_all)::BIGINT"
) + """,
aside AS (SELECT *, n - k1_q AS n_aside, sum(n - k1_q) OVER ()::BIGINT AS all_aside FROM k1),""" + _sql_quota(
    "k2", "aside", "n_aside", "all_aside", "all_aside - ceil(0.5::DOUBLE * all_aside)::BIGINT"
) + f""",
ksplit AS (
  SELECT doc_id, CASE WHEN r <= n_aside - k2_q THEN 'test' WHEN r <= n_aside THEN 'val' ELSE 'train' END AS split
  FROM kranked JOIN k2 USING (code)),
{SQL_VOTES}, {_sql_weights("WHERE doc_id IN (SELECT doc_id FROM ksplit WHERE split = 'train')")}, {_sql_weighted()},
again AS (
  SELECT s.doc_id, s.split, ['HATE', 'OFFENSIVE', 'NEUTRAL'][wv_label + 1] AS ws_v2, round_even(wv_conf, 4) AS ws_v2_conf,
    wv_novote, r.gpt_label, r.llama_label
  FROM ksplit s JOIN wv USING (doc_id) JOIN resolved r USING (doc_id)),
final AS (
  SELECT *, CASE WHEN ws_v2 = gpt_label OR ws_v2 = llama_label THEN ws_v2 ELSE gpt_label END AS label3,
    CASE (SELECT count(DISTINCT x) FROM unnest([ws_v2, gpt_label, llama_label]) AS t(x))
      WHEN 1 THEN 'full_agreement' WHEN 2 THEN 'majority_vote' ELSE 'gpt_tiebreaker' END AS method_v2
  FROM again)
SELECT doc_id AS orig_id, split, ws_v2, ws_v2_conf, wv_novote::INTEGER AS ws_novote, label3,
  CASE WHEN label3 = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'HARMFUL' END AS label_bin, method_v2 FROM final"""


@query("frozen_manifest_labels", SQL_FREEZE_LABELS)
def frozen_manifest_labels(spark, sf):
    """Split, re-weighted weak label and re-resolved consensus of every kept text."""
    m = CF.freeze_corpus(annotated(spark, sf), PLAN)["manifest"]
    return m.select(
        "orig_id", "split", "ws_v2", "ws_v2_conf", "ws_novote", "label3", "label_bin", "method_v2"
    )


# The documents as a pooled corpus: label and language are one, a source is a file.  Texts with one key and several labels go, of
# others the smallest id stays, and splits go by key.
SQL_POOL_KEPT = f"""{SQL_KEYS},
kept AS (SELECT uid, min(doc_id) AS pool_id, min(lang) AS lang FROM keys WHERE NOT is_empty GROUP BY uid HAVING count(DISTINCT lang) = 1),
pool AS (SELECT uid AS doc_id, lang FROM kept)"""


def _over_pool(sql):
    return sql.replace("FROM documents),\nranked", "FROM pool),\nranked")


def pooled(spark, sf):
    return texts(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("source").alias("src_file"), "text")


@query("frozen_auxiliary", f"""WITH {SQL_POOL_KEPT}, {_over_pool(SQL_NESTED)},
main AS (SELECT uid, max((doc_id % 5 = 0)::INTEGER) AS held FROM keys WHERE doc_id % 3 = 0 GROUP BY uid)
SELECT k.uid, k.pool_id, s.split, k.lang AS label, d.source AS src_file, (m.uid IS NOT NULL)::INTEGER AS collides_hs_any,
  coalesce(m.held, 0) AS mtl_exclude, x.raw_sha256, md5(d.text) AS text_md5
FROM kept k JOIN split s ON s.doc_id = k.uid JOIN documents d ON d.doc_id = k.pool_id JOIN keys x ON x.doc_id = k.pool_id
LEFT JOIN main m ON m.uid = k.uid""")
def frozen_auxiliary(spark, sf):
    """A second corpus frozen beside a main one (every third document), flagged where it meets it and its held-out part."""
    keys = D.text_keys(texts(spark, sf), "text", ["doc_id"], PROFILE)
    main = keys.filter(F.col("doc_id") % 3 == 0).select("uid", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    out = CF.freeze_auxiliary(pooled(spark, sf), stage(main, "main"), LANGS, profile=PROFILE)
    return out.withColumn("text_md5", F.md5("text")).drop("text")


@query("frozen_folds", f"""WITH {SQL_POOL_KEPT}, {_over_pool(SQL_FOLDS)}
SELECT k.uid, k.pool_id, m.fold, m.part, k.lang AS label, d.source AS src_file, x.raw_sha256, md5(d.text) AS text_md5
FROM kept k JOIN member m ON m.doc_id = k.uid JOIN documents d ON d.doc_id = k.pool_id JOIN keys x ON x.doc_id = k.pool_id""")
def frozen_folds(spark, sf):
    """The pooled corpus frozen in ten folds; every row with its role in every fold."""
    out = CF.freeze_folds(pooled(spark, sf), LANGS, profile=PROFILE)
    return out.select("uid", "pool_id", F.posexplode("parts").alias("fold", "part"), "label", "src_file", "raw_sha256",
                      F.md5("text").alias("text_md5"))


@query("load_task", f"""SELECT x.orig_id, uid, md5(text) AS text_md5, split, (list_position(['HATE', 'OFFENSIVE', 'NEUTRAL'], label3) - 1)::INTEGER AS y
FROM ({SQL_FREEZE_LABELS}) x JOIN documents d ON d.doc_id = x.orig_id JOIN (WITH {SQL_KEYS} SELECT doc_id, uid FROM keys) u ON u.doc_id = x.orig_id""")
def load_task(spark, sf):
    """The frozen manifest, stored, proven and opened as one table per partition."""
    path = fresh(spark, "manifest-table")
    CF.freeze_corpus(annotated(spark, sf), PLAN)["manifest"].write.partitionBy("split").parquet(path)
    manifest = spark.read.parquet(path)
    task = TL.load_task(manifest, "label3", ["HATE", "OFFENSIVE", "NEUTRAL"], recorded=TL.manifest_digest(manifest),
                        keep=["orig_id"], profile=PROFILE, stop_words=STOP_WORDS)
    out = None
    for part, rows in task.items():
        named = rows.select("orig_id", "uid", F.md5("text").alias("text_md5"), F.lit(part).alias("split"), "y")
        out = named if out is None else out.unionByName(named)
    return out
