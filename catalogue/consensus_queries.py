"""Three annotators: resolution, coarsening, table checks, re-resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import query, table
from labelloom.operators import consensus as C
from labelloom.operators import weak

SQL_ANNOTATORS = """
ann AS (
  SELECT doc_id,
    CASE WHEN doc_id % 5 = 0 THEN ['HATE', 'OFFENSIVE', 'NEUTRAL'][doc_id % 3 + 1] ELSE g END AS ws_label,
    CASE WHEN doc_id % 7 = 0 THEN ['HATE', 'OFFENSIVE', 'NEUTRAL'][(doc_id + 1) % 3 + 1] ELSE g END AS gpt_label,
    CASE WHEN doc_id % 11 = 0 THEN ['HATE', 'OFFENSIVE', 'NEUTRAL'][(doc_id + 2) % 3 + 1] ELSE g END AS llama_label
  FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'HATE' WHEN quality = 0 THEN 'OFFENSIVE' ELSE 'NEUTRAL' END AS g
        FROM labels))"""
SQL_RESOLVED = SQL_ANNOTATORS + """,
resolved AS (
  SELECT *, CASE WHEN ws_label = gpt_label OR ws_label = llama_label THEN ws_label ELSE gpt_label END AS final_label,
    CASE (SELECT count(DISTINCT x) FROM unnest([ws_label, gpt_label, llama_label]) AS t(x))
      WHEN 1 THEN 'full_agreement' WHEN 2 THEN 'majority_vote' ELSE 'gpt_tiebreaker' END AS method
  FROM ann)"""
ANNOTATORS = ("ws_label", "gpt_label", "llama_label")


def annotators(spark, sf):
    g = F.when(F.col("toxic") == 1, "HATE").when(F.col("quality") == 0, "OFFENSIVE").otherwise("NEUTRAL")
    names = F.array(F.lit("HATE"), F.lit("OFFENSIVE"), F.lit("NEUTRAL"))

    def ann(step, shift):
        other = F.get(names, ((F.col("doc_id") + shift) % 3).cast("int"))
        return F.when(F.col("doc_id") % step == 0, other).otherwise(g)

    return table(spark, sf, "labels").select(
        "doc_id", ann(5, 0).alias("ws_label"), ann(7, 1).alias("gpt_label"), ann(11, 2).alias("llama_label")
    )


@query("consensus", f"WITH {SQL_RESOLVED} SELECT * FROM resolved")
def consensus(spark, sf):
    return C.consensus(annotators(spark, sf), ANNOTATORS, "gpt_label")


@query("label_coarsen", f"""WITH {SQL_RESOLVED}
SELECT doc_id, CASE WHEN final_label = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'HARMFUL' END AS label_bin FROM resolved""")
def label_coarsen(spark, sf):
    df = C.consensus(annotators(spark, sf), ANNOTATORS, "gpt_label")
    mapping = {"HATE": "HARMFUL", "OFFENSIVE": "HARMFUL"}
    return df.select("doc_id", C.coarsen("final_label", mapping, "NEUTRAL").alias("label_bin"))


SQL_ALIGNED = f"""WITH {SQL_RESOLVED},
res AS (SELECT r.*, replace(replace(d.text, chr(9), ' '), chr(10), ' ') AS text, md5(d.text) AS raw FROM resolved r JOIN documents d USING (doc_id)),
d3 AS (SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN concat(text, '!') ELSE text END AS text,
  CASE WHEN doc_id % 97 = 0 THEN 'NEUTRAL' ELSE final_label END AS label FROM res WHERE doc_id % 211 <> 0),
db AS (SELECT doc_id, text, CASE WHEN final_label = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'HARMFUL' END AS label FROM res),
ws AS (SELECT doc_id, CASE WHEN doc_id % 83 = 0 THEN 'HATE' ELSE ws_label END AS label_name FROM res)"""
_CHECKS = {
    "resolved_text_eq_3class": "res.text = d3.text",
    "resolved_final_eq_3class": "res.final_label = d3.label",
    "binary_text_eq_3class": "db.text = d3.text",
    "binary_eq_rule": "CASE WHEN d3.label IS NULL THEN NULL WHEN d3.label = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'HARMFUL' END = db.label",
    "ws_eq_resolved": "ws.label_name = res.ws_label",
    "final_eq_rule": "CASE WHEN res.ws_label = res.gpt_label OR res.ws_label = res.llama_label THEN res.ws_label ELSE res.gpt_label END = res.final_label",
    "method_eq_rule": "CASE (SELECT count(DISTINCT x) FROM unnest([res.ws_label, res.gpt_label, res.llama_label]) AS t(x)) "
                      "WHEN 1 THEN 'full_agreement' WHEN 2 THEN 'majority_vote' ELSE 'gpt_tiebreaker' END = res.method",
    "resolved_text_eq_corpus": "res.text = replace(replace(c.text, chr(9), ' '), chr(10), ' ')",
    "human_verified": "res.doc_id % 13 = 0",
}
SQL_CHECKED = SQL_ALIGNED + """,
corpus AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id)),
j AS (SELECT """ + ", ".join(f"coalesce({c}, false) AS {n}" for n, c in _CHECKS.items()) + """
  FROM res LEFT JOIN d3 USING (doc_id) LEFT JOIN db USING (doc_id) LEFT JOIN ws USING (doc_id) LEFT JOIN corpus c USING (doc_id))
""" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", count(*) AS n, count(*) FILTER (WHERE {n}) AS n_ok, "
    + ("true" if n == "human_verified" else f"bool_and({n})") + " AS ok FROM j" for n in _CHECKS)


@query("consensus_checks", SQL_CHECKED)
def consensus_checks(spark, sf):
    """Five row-aligned tables: resolved labels, three-class and binary sets, weak labels, corpus.  Some texts and labels differ and
    some rows are missing; texts are compared by hash."""
    df = C.consensus(annotators(spark, sf), ANNOTATORS, "gpt_label")
    mapping = {"HATE": "HARMFUL", "OFFENSIVE": "HARMFUL"}
    docs = table(spark, sf, "documents").select("doc_id", "text")
    flat = F.translate("text", "\t\n", "  ")
    res = df.join(docs, "doc_id").select(*df.columns, F.sha2(flat, 256).alias("text"), F.sha2(F.concat(flat, F.lit("!")), 256).alias("_other"))
    third = lambda n: F.col("doc_id") % n == 0
    d3 = res.filter(~third(211)).select(
        "doc_id", F.when(third(89), F.col("_other")).otherwise(F.col("text")).alias("text"),
        F.when(third(97), "NEUTRAL").otherwise(F.col("final_label")).alias("label"))
    binary = res.select("doc_id", "text", C.coarsen("final_label", mapping, "NEUTRAL").alias("label"))
    ws = res.select("doc_id", F.when(third(83), "HATE").otherwise(F.col("ws_label")).alias("label_name"))
    corpus = docs.join(annotators(spark, sf).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2(flat, 256).alias("text"))
    label, method = C.resolve(("res_ws_label", "res_gpt_label", "res_llama_label"), "res_gpt_label")
    checks = {
        "resolved_text_eq_3class": F.col("res_text") == F.col("d3_text"),
        "resolved_final_eq_3class": F.col("res_final_label") == F.col("d3_label"),
        "binary_text_eq_3class": F.col("bin_text") == F.col("d3_text"),
        "binary_eq_rule": F.when(F.col("d3_label").isNotNull(), C.coarsen("d3_label", mapping, "NEUTRAL") == F.col("bin_label")),
        "ws_eq_resolved": F.col("ws_label_name") == F.col("res_ws_label"),
        "final_eq_rule": label == F.col("res_final_label"),
        "method_eq_rule": method == F.col("res_method"),
        "resolved_text_eq_corpus": F.col("res_text") == F.col("corpus_text"),
        "human_verified": F.col("doc_id") % 13 == 0,
    }
    return C.table_checks(
        {"res": res.drop("_other"), "d3": d3, "bin": binary, "ws": ws, "corpus": corpus}, "doc_id", checks, report_only=["human_verified"])


@query("re_resolve", f"""WITH {SQL_RESOLVED},
again AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'HATE' ELSE ws_label END AS ws2 FROM resolved),
r2 AS (SELECT doc_id, final_label, method, CASE WHEN ws2 = gpt_label OR ws2 = llama_label THEN ws2 ELSE gpt_label END AS label3,
    CASE (SELECT count(DISTINCT x) FROM unnest([ws2, gpt_label, llama_label]) AS t(x))
      WHEN 1 THEN 'full_agreement' WHEN 2 THEN 'majority_vote' ELSE 'gpt_tiebreaker' END AS method_v2 FROM again)
SELECT method, method_v2, count(*) AS n, count(*) FILTER (WHERE final_label <> label3) AS changed
FROM r2 GROUP BY method, method_v2""")
def re_resolve(spark, sf):
    """A re-weighted weak label changes the consensus: old method x new method."""
    df = C.consensus(annotators(spark, sf), ANNOTATORS, "gpt_label")
    ws2 = F.when(F.col("doc_id") % 3 == 0, "HATE").otherwise(F.col("ws_label"))
    again = C.consensus(
        df.withColumn("ws2", ws2), ("ws2", "gpt_label", "llama_label"), "gpt_label", "label3", "method_v2"
    )
    return again.groupBy("method", "method_v2").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_label") != F.col("label3")).alias("changed")
    )


@query("annotator_agreement", f"""WITH {SQL_ANNOTATORS}
SELECT count(*) AS n, count(*) FILTER (WHERE gpt_label = llama_label) AS n_agree,
  round(count(*) FILTER (WHERE gpt_label = llama_label)::DOUBLE / count(*), 9) AS agreement FROM ann""")
def annotator_agreement(spark, sf):
    return weak.agreement(annotators(spark, sf), "gpt_label", "llama_label").withColumn(
        "agreement", F.round("agreement", 9)
    )
