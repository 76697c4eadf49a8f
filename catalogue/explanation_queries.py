"""Attribution aggregates over every word of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import SQL_PREDICTIONS, SQL_WS, predictions, query, texts
from labelloom.functions.text import words
from labelloom.operators import attribution as X

SQL_TOKENS = f"""
toks AS (
  SELECT doc_id AS uid, u.i - 1 AS pos, w[u.i] AS token
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[{SQL_WS}]+'), lambda x: x <> '') AS w FROM documents) s,
  unnest(range(1, len(w) + 1)) AS u(i))"""
SQL_ATTR = SQL_TOKENS + """,
attr AS (
  SELECT uid, pos, token, cls, (((length(token) * 13 + cls * 5 + pos) % 21) - 10)::DOUBLE AS value
  FROM toks, (VALUES (0), (1)) c(cls))"""


#: Texts a task takes when they are dealt by id; their words and ranks fit its memory.
TEXTS_PER_TASK = 4096


def tokens(spark, sf, by_text=False):
    """Words of every document; with ``by_text`` the texts are dealt by id, so that what is grouped by text later stays in its task."""
    docs = texts(spark, sf).select(F.col("doc_id").alias("uid"), "text")
    if by_text:
        docs = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-docs.count() // TEXTS_PER_TASK)), "uid")
    return docs.select("uid", F.posexplode(words(F.col("text"))).alias("pos", "token"))


def attributions(spark, sf):
    """Each word of each document with one value per class, derived from the word's length and place."""
    value = [((F.length("token") * 13 + c * 5 + F.col("pos")) % 21 - 10).cast("double") for c in (0, 1)]
    return tokens(spark, sf).withColumn("values", F.array(*value))


@query("shap_global", f"""WITH {SQL_ATTR}
SELECT token, round(sum(abs(value)) / (count(*) // 2), 9) AS mean_abs, count(*) // 2 AS "count" FROM attr
GROUP BY token ORDER BY round(sum(abs(value)) / (count(*) // 2), 12) DESC, token LIMIT 100""")
def shap_global(spark, sf):
    return X.global_importance(attributions(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 9))


@query("shap_per_class", f"""WITH {SQL_ATTR},
g AS (SELECT cls, token, round(avg(value), 12) AS m, count(*) AS n FROM attr GROUP BY cls, token HAVING count(*) >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY m DESC, token) AS rank FROM g)
SELECT cls::INTEGER AS cls, token, round(m, 9) AS mean_value, n AS "count", rank::INTEGER AS rank FROM k WHERE rank <= 30""")
def shap_per_class(spark, sf):
    return X.class_importance(attributions(spark, sf)).withColumn("mean_value", F.round("mean_value", 9))


@query("tag_examples", f"""WITH {SQL_PREDICTIONS}
SELECT system, seed, uid, ['HATE', 'OFFENSIVE', 'NEUTRAL'][y + 1] AS true_label,
  ['HATE', 'OFFENSIVE', 'NEUTRAL'][pred + 1] AS pred_label, pred = y AS correct FROM preds WHERE split = 'test'""")
def tag_examples(spark, sf):
    test = predictions(spark, sf).filter(F.col("split") == "test")
    tagged = X.tag_examples(test, ["HATE", "OFFENSIVE", "NEUTRAL"])
    return tagged.select("system", "seed", "uid", "true_label", "pred_label", "correct")


SQL_WEIGHTS = SQL_TOKENS + """,
one AS (SELECT uid, token, min(pos) AS pos FROM toks GROUP BY uid, token),
wts AS (
  SELECT m.model, uid, token, pos, (((length(token) * 13 + m.model * 5 + pos * 7) % 41) - 20)::DOUBLE AS weight
  FROM one, (VALUES (0), (1)) m(model) WHERE (m.model = 0 AND pos % 5 <> 0) OR (m.model = 1 AND pos % 7 <> 0)),
topk AS (SELECT *, row_number() OVER (PARTITION BY model, uid ORDER BY abs(weight) DESC, pos) <= 5 AS top FROM wts),
tp AS (
  SELECT coalesce(a.uid, b.uid) AS uid, coalesce(a.token, b.token) AS token, a.weight AS w_base, b.weight AS w_other,
    coalesce(a.top, false) AS top_base, coalesce(b.top, false) AS top_other, b.weight - a.weight AS delta
  FROM (SELECT * FROM topk WHERE model = 0) a FULL JOIN (SELECT * FROM topk WHERE model = 1) b
    ON a.uid = b.uid AND a.token = b.token)"""
SQL_COMPARE = SQL_WEIGHTS + """,
sh AS (
  SELECT uid, rank() OVER (PARTITION BY uid ORDER BY w_base) + (count(*) OVER (PARTITION BY uid, w_base) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY uid ORDER BY w_other) + (count(*) OVER (PARTITION BY uid, w_other) - 1) / 2.0::DOUBLE AS rb
  FROM tp WHERE w_base IS NOT NULL AND w_other IS NOT NULL),
rho AS (SELECT uid, count(*) AS n_shared,
    CASE WHEN count(*) >= 3 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN corr(ra, rb) END AS spearman
  FROM sh GROUP BY uid),
jac AS (SELECT uid, count(*) FILTER (WHERE top_base AND top_other)::DOUBLE
    / greatest(count(*) FILTER (WHERE top_base OR top_other), 1) AS jaccard FROM tp GROUP BY uid),
cmp AS (SELECT j.uid, jaccard, coalesce(n_shared, 0) AS n_shared, spearman FROM jac j LEFT JOIN rho r ON j.uid = r.uid)"""


def pairs(spark, sf):
    """Two explanations of every document: one weight per distinct word, each model blind to some."""
    one = tokens(spark, sf, by_text=True).groupBy("uid", "token").agg(F.min("pos").alias("pos"))

    def weight(model):
        return ((F.length("token") * 13 + model * 5 + F.col("pos") * 7) % 41 - 20).cast("double").alias("weight")

    base = one.filter(F.col("pos") % 5 != 0).select("uid", "pos", "token", weight(0))
    other = one.filter(F.col("pos") % 7 != 0).select("uid", "pos", "token", weight(1))
    return X.token_pairs(base, other, 5)


@query("token_delta", f"""WITH {SQL_TOKENS},
one AS (SELECT uid, token, min(pos) AS pos FROM toks GROUP BY uid, token),
two AS (SELECT uid, token, pos,
  CASE WHEN pos % 5 <> 0 THEN (((length(token) * 13 + pos * 7) % 41) - 20)::DOUBLE END AS w_base,
  CASE WHEN pos % 7 <> 0 THEN (((length(token) * 13 + 5 + pos * 7) % 41) - 20)::DOUBLE END AS w_other FROM one),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY abs(w_base) DESC NULLS LAST, pos) AS k_base,
  row_number() OVER (PARTITION BY uid ORDER BY abs(w_other) DESC NULLS LAST, pos) AS k_other FROM two)
SELECT uid, token, w_base, w_other, w_base IS NOT NULL AND k_base <= 5 AS top_base,
  w_other IS NOT NULL AND k_other <= 5 AS top_other, w_other - w_base AS delta
FROM ranked WHERE w_base IS NOT NULL OR w_other IS NOT NULL""")
def token_delta(spark, sf):
    return pairs(spark, sf)


@query("lime_compare", f"""WITH {SQL_COMPARE}
SELECT uid, round(jaccard, 9) AS jaccard, n_shared, round(spearman, 6) AS spearman FROM cmp""")
def lime_compare(spark, sf):
    out = X.compare_explanations(pairs(spark, sf))
    return out.withColumn("jaccard", F.round("jaccard", 9)).withColumn("spearman", F.round("spearman", 6))


@query("lime_summary", f"""WITH {SQL_COMPARE}
SELECT count(*) AS n_instances, round(avg(jaccard), 6) AS mean_jaccard, round(avg(spearman), 6) AS mean_spearman FROM cmp""")
def lime_summary(spark, sf):
    out = X.comparison_summary(X.compare_explanations(pairs(spark, sf)))
    return out.withColumn("mean_jaccard", F.round("mean_jaccard", 6)).withColumn(
        "mean_spearman", F.round("mean_spearman", 6)
    )
