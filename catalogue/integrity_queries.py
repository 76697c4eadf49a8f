"""Leakage under every representation, uniqueness, digests, freeze and firewall."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import (
    N_CLASSES, PROFILE, SQL_PREDICTIONS, STOP_WORDS, SYSTEMS, predictions, query, sql_bag, sql_keys,
    sql_minimal, table, texts,
)
from catalogue.split_queries import LANGS, SQL_FOLDS, SQL_SPLIT
from labelloom.operators import dedup as D
from labelloom.functions.staging import fresh_path
from labelloom.operators import integrity as I
from labelloom.operators import selection as Sel
from labelloom.operators import splits as S

SQL_VIEWS = sql_keys("documents", "doc_id", extra="s.text") + f""",
view_keys AS (
  SELECT doc_id, 'uid' AS view, uid AS key FROM keys
  UNION ALL SELECT doc_id, 'raw_sha256', raw_sha256 FROM keys
  UNION ALL SELECT doc_id, 'none', sha256(text) FROM keys
  UNION ALL SELECT doc_id, 'minimal', sha256({sql_minimal('text')}) FROM keys
  UNION ALL SELECT doc_id, 'alg3', sha256(t) FROM keys_n
  UNION ALL SELECT doc_id, 'mhamed', sha256({sql_bag('text')}) FROM keys),
pairs AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(a, b)),
views AS (SELECT DISTINCT view FROM view_keys)"""


def keyed_documents(spark, sf):
    """The six keys of every document: only these travel to meet the partition names."""
    k = D.text_keys(texts(spark, sf), "text", ["doc_id", "text"], PROFILE)
    return k.select("doc_id", I.representation_keys("text", PROFILE, STOP_WORDS).alias("keys"))


@query("leakage_matrix", f"""WITH {SQL_VIEWS}, {SQL_SPLIT},
vs AS (SELECT DISTINCT view, key, split FROM view_keys JOIN split USING (doc_id))
SELECT v.view, concat(p.a, '&', p.b) AS pair, count(y.key) AS n_shared, v.view <> 'mhamed' AS fatal,
  v.view <> 'mhamed' AND count(y.key) > 0 AS leak
FROM views v CROSS JOIN pairs p
LEFT JOIN vs x ON x.view = v.view AND x.split = p.a
LEFT JOIN vs y ON y.view = v.view AND y.split = p.b AND y.key = x.key
GROUP BY v.view, p.a, p.b""")
def leakage_matrix(spark, sf):
    split = S.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", LANGS, 42)
    df = keyed_documents(spark, sf).join(split.select("doc_id", "split"), "doc_id")
    return I.with_severity(I.leakage_matrix(df, F.col("keys"), "split"))


@query("leakage_by_fold", f"""WITH {SQL_VIEWS}, {SQL_FOLDS},
vs AS (SELECT DISTINCT view, fold, key, part FROM view_keys JOIN member USING (doc_id)),
seen AS (SELECT view, fold, key, list(part) AS parts FROM vs GROUP BY view, fold, key)
SELECT fold::INTEGER AS fold, view, concat(a, '&', b) AS pair,
  count(*) FILTER (WHERE list_contains(parts, a) AND list_contains(parts, b)) AS n_shared
FROM seen CROSS JOIN pairs GROUP BY fold, view, a, b""")
def leakage_by_fold(spark, sf):
    folds = S.stratified_kfold(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", LANGS, 42)
    df = keyed_documents(spark, sf).join(folds.select("doc_id", "parts"), "doc_id")
    return I.leakage_by_fold(df, F.col("keys"), "parts", 10)


@query("uid_unique", f"""WITH {sql_keys('documents', 'doc_id')},
g AS (SELECT uid, count(*) AS n FROM keys GROUP BY uid)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated FROM g""")
def uid_unique(spark, sf):
    return I.repeated_keys(D.text_keys(texts(spark, sf), "text", ["doc_id"], PROFILE))


def _sql_fp(columns: list[str]) -> str:
    parts = ", ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in columns)
    return f"('0x' || substr(md5(concat_ws(',', {parts})), 1, 15))::BIGINT"


_DIGEST = "count(*) AS n_rows, CAST(sum(fp::HUGEINT) AS VARCHAR) AS fp_sum, bit_xor(fp) AS fp_xor"


@query("content_digest", f"""
WITH f AS (SELECT lang, {_sql_fp(['doc_id', 'text', 'lang', 'source', 'n_chars'])} AS fp FROM documents)
SELECT lang, {_DIGEST} FROM f GROUP BY lang""")
def content_digest(spark, sf):
    return I.content_digest(
        texts(spark, sf), ["doc_id", "text", "lang", "source", "n_chars"], ["lang"]
    )


@query("digest_changes", f"""
WITH a AS (SELECT source, {_sql_fp(['doc_id', 'text'])} AS fp FROM documents),
b AS (SELECT source, {_sql_fp(['doc_id', "CASE WHEN source = 'src3' THEN concat(text, '!') ELSE text END"])} AS fp FROM documents),
da AS (SELECT source, concat_ws(':', count(*), CAST(sum(fp::HUGEINT) AS VARCHAR), bit_xor(fp)) AS digest_before FROM a GROUP BY source),
db AS (SELECT source, concat_ws(':', count(*), CAST(sum(fp::HUGEINT) AS VARCHAR), bit_xor(fp)) AS digest_after FROM b GROUP BY source)
SELECT source, digest_before, digest_after FROM da JOIN db USING (source) WHERE digest_before <> digest_after""")
def digest_changes(spark, sf):
    d = texts(spark, sf)
    tampered = d.withColumn("text", F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    before = I.content_digest(d, ["doc_id", "text"], ["source"])
    return I.digest_changes(before, I.content_digest(tampered, ["doc_id", "text"], ["source"]), ["source"])


SQL_RUN_DIGESTS = f"""
rows_fp AS (SELECT system, seed, {_sql_fp(['uid', 'y', 'pred'])} AS fp FROM preds WHERE split = 'val'),
run_digest AS (SELECT system, seed, {_DIGEST} FROM rows_fp GROUP BY system, seed),
inputs AS (
  SELECT system, sha256(string_agg(concat_ws(':', seed, n_rows, fp_sum, fp_xor), chr(10)
    ORDER BY concat_ws(':', seed, n_rows, fp_sum, fp_xor))) AS inputs_sha256, count(*) AS n_inputs
  FROM run_digest GROUP BY system)"""


def _run_digests(spark, sf):
    val = Sel.validation_only(predictions(spark, sf)).withColumn("pred", I.argmax("probs"))
    return I.content_digest(val, ["uid", "y", "pred"], ["system", "seed"])


@query("input_digest", f"WITH {SQL_PREDICTIONS}, {SQL_RUN_DIGESTS} SELECT * FROM inputs")
def input_digest(spark, sf):
    return I.input_hash(_run_digests(spark, sf), ["system"], ["seed"])


@query("selection_written", f"""WITH {SQL_PREDICTIONS}, {SQL_RUN_DIGESTS}
SELECT concat('best_', system) AS name, system AS chosen, inputs_sha256 FROM inputs""")
def selection_written(spark, sf):
    """Selections stored once; the repeat finds them unchanged."""
    inputs = I.input_hash(_run_digests(spark, sf), ["system"], ["seed"])
    sel = inputs.select(F.concat(F.lit("best_"), "system").alias("name"), F.col("system").alias("chosen"), "inputs_sha256")
    path = fresh_path(spark, "selections")
    Sel.write_once(sel, path)
    return Sel.write_once(sel, path).select("name", "chosen", "inputs_sha256")


@query("freeze_check", f"""WITH {SQL_PREDICTIONS}, {SQL_RUN_DIGESTS}
SELECT concat('best_', system) AS name,
  CASE system WHEN 'm1' THEN 'changed' WHEN 'm2' THEN 'missing' ELSE 'ok' END AS status FROM inputs
UNION ALL SELECT 'best_m9', 'unfrozen'""")
def freeze_check(spark, sf):
    """Selections frozen with the digests of their inputs; afterwards one changed and one is gone."""
    inputs = I.input_hash(_run_digests(spark, sf), ["system"], ["seed"])
    sel = inputs.select(F.concat(F.lit("best_"), "system").alias("name"), F.col("inputs_sha256").alias("chosen"))
    frozen = Sel.selection_digest(sel, "name", ["chosen"])
    later = sel.filter(F.col("name") != "best_m2").withColumn(
        "chosen", F.when(F.col("name") == "best_m1", F.reverse("chosen")).otherwise(F.col("chosen"))
    )
    expected = [f"best_{s}" for s in SYSTEMS] + ["best_m9"]
    return I.freeze_check(frozen, Sel.selection_digest(later, "name", ["chosen"]), expected)


@query("firewall_check", f"""WITH {SQL_PREDICTIONS},
stamped AS (SELECT system, split, seed * 100 + CAST(substr(system, 2) AS INTEGER) AS ts FROM preds),
sel AS (SELECT * FROM (VALUES ('s_early', 'm0', 4100), ('s_mid', 'm1', 4250), ('s_late', 'm2', 9000)) t(name, system, frozen_at))
SELECT s.name, count(*) AS n_test_rows, count(*) FILTER (WHERE p.ts <= s.frozen_at) AS n_before_freeze,
  min(p.ts) > max(s.frozen_at) AS ok
FROM sel s JOIN stamped p ON s.system = p.system AND p.split = 'test' GROUP BY s.name""")
def firewall_check(spark, sf):
    """Prediction stamps grow with the seed; three selections were frozen at different times."""
    stamped = predictions(spark, sf).withColumn(
        "ts", F.col("seed") * 100 + F.substring("system", 2, 1).cast("int")
    )
    sel = spark.createDataFrame(
        [("s_early", "m0", 4100), ("s_mid", "m1", 4250), ("s_late", "m2", 9000)],
        "name string, system string, frozen_at int",
    )
    return I.firewall_check(sel, stamped, "system", "split", "ts")


@query("prediction_repro", f"""WITH {SQL_PREDICTIONS}
SELECT a.seed, count(*) AS n, 0::BIGINT AS n_unmatched,
  round(avg((a.pred = b.pred)::INTEGER::DOUBLE), 9) AS argmax_agreement,
  round(max(greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2))), 9) AS max_abs_diff,
  avg((a.pred = b.pred)::INTEGER) >= 0.99 AS ok
FROM preds a JOIN preds b ON a.uid = b.uid AND a.seed = b.seed AND a.system = 'm0' AND b.system = 'm1'
GROUP BY a.seed""")
def prediction_repro(spark, sf):
    p = predictions(spark, sf)
    a, b = (p.filter(F.col("system") == s).select("seed", "uid", "probs") for s in ("m0", "m1"))
    out = I.reproduction_check(a, b, ["seed", "uid"], "probs", ["seed"])
    return out.withColumn("argmax_agreement", F.round("argmax_agreement", 9)).withColumn(
        "max_abs_diff", F.round("max_abs_diff", 9)
    )


@query("alignment_check", f"""WITH {SQL_PREDICTIONS},
damaged AS (
  SELECT system, seed, uid, CASE WHEN system = 'm2' AND uid % 50 = 1 THEN 0 ELSE y END AS y FROM preds
  WHERE NOT (system = 'm1' AND uid % 40 = 0)),
g AS (SELECT seed, uid, count(*) AS n, count(DISTINCT system) AS k, min(y) <> max(y) AS mixed FROM damaged GROUP BY seed, uid)
SELECT seed, count(*) AS n_keys, count(*) FILTER (WHERE n <> 4 OR k <> 4) AS misaligned,
  count(*) FILTER (WHERE mixed) AS label_mismatch, 0::BIGINT AS wrong_width FROM g GROUP BY seed""")
def alignment_check(spark, sf):
    """Predictions with some rows missing and some truths altered."""
    p = predictions(spark, sf).filter(~((F.col("system") == "m1") & (F.col("uid") % 40 == 0)))
    p = p.withColumn("y", F.when((F.col("system") == "m2") & (F.col("uid") % 50 == 1), 0).otherwise(F.col("y")))
    return I.alignment_check(p, SYSTEMS, "system", ["seed"], "uid", "y", N_CLASSES)
