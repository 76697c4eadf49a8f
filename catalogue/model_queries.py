"""Vocabulary, encoding, score arithmetic and the MLlib model stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import N_CLASSES, PROFILE, SQL_LABELS3, labels3, query, sql_full, table, texts
from labelloom.functions import arrays as A
from labelloom.functions.staging import stage
from labelloom.functions.text import full
from labelloom.operators import attribution as X
from labelloom.operators import splits as S
from labelloom.operators import training as T
from labelloom.operators import vocab as V

_SQL_FILTERS = r"[!\x{22}#$%&()*+,\x{2D}./:;<=>?@\[\x{5C}\]^_`{|}~\t\n]"
SQL_VOCAB = f"""
split_words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '{_SQL_FILTERS}', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
toks AS (SELECT doc_id, u.i - 1 AS pos, w[u.i] AS word FROM split_words, unnest(range(1, len(w) + 1)) AS u(i)),
train_toks AS (SELECT * FROM toks WHERE substr(md5(concat(CAST(doc_id AS VARCHAR), ':42')), 1, 1) NOT IN ('0', '1', '2')),
firsts AS (SELECT word, count(*) AS n, min(doc_id * 16777216 + pos) AS f FROM train_toks GROUP BY word),
vocab AS (SELECT word, n, f // 16777216 AS first_row, f % 16777216 AS first_pos, row_number() OVER (ORDER BY n DESC, f) AS idx FROM firsts)"""


def train_documents(spark, sf):
    digit = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), 1, 1)
    return texts(spark, sf).filter(~digit.isin("0", "1", "2"))


def vocabulary(spark, sf):
    return V.fit_vocabulary(train_documents(spark, sf), "text", "doc_id")


@query("vocab_fit", f"WITH {SQL_VOCAB} SELECT * FROM vocab")
def vocab_fit(spark, sf):
    return vocabulary(spark, sf)


@query("vocab_size", f"WITH {SQL_VOCAB} SELECT least(count(*) + 1, 5000) AS vocab_size FROM vocab")
def vocab_size(spark, sf):
    return V.vocabulary_size(vocabulary(spark, sf), 5000)


@query("vocab_encode", f"""WITH {SQL_VOCAB},
known AS (SELECT t.doc_id, t.pos, v.idx, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos DESC) AS back
  FROM toks t JOIN vocab v USING (word) WHERE v.idx < 5000),
tail AS (SELECT doc_id, list(idx ORDER BY pos) AS l FROM known WHERE back <= 80 GROUP BY doc_id),
padded AS (SELECT d.doc_id, list_concat(list_transform(range(0, 80 - coalesce(len(l), 0)), lambda x: 0::BIGINT), coalesce(l, [])) AS ids
  FROM documents d LEFT JOIN tail USING (doc_id))
SELECT doc_id, md5(array_to_string(ids, ',')) AS ids_md5, len(ids)::INTEGER AS n, len(list_filter(ids, lambda x: x > 0))::INTEGER AS n_known FROM padded""")
def vocab_encode(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    enc = V.encode(docs, "doc_id", "text", vocabulary(spark, sf), 5000, 80)
    return enc.select(
        "doc_id", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"),
        F.size("ids").alias("n"), F.size(F.filter("ids", lambda i: i > 0)).alias("n_known"),
    )


SQL_SOFT = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
s AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM e)"""


@query("softmax_argmax", f"""WITH {SQL_SOFT}
SELECT vec_id, list_position(z, list_max(z))::INTEGER - 1 AS pred, round(list_max(ex) / list_sum(ex), 9) AS top_prob,
  round(ln(greatest(list_min(ex) / list_sum(ex), 1e-12)), 6) AS min_log_prob FROM s""")
def softmax_argmax(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", A.softmax("embedding").alias("p"))
    return e.select(
        "vec_id", A.argmax("embedding").alias("pred"), F.round(F.array_max("p"), 9).alias("top_prob"),
        F.round(F.array_min(A.log_probs("p")), 6).alias("min_log_prob"),
    )


@query("cross_entropy", """WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS t,
    list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS s FROM embeddings),
l AS (SELECT *, ln(list_sum(list_transform(t, lambda x: exp(x)))) AS lt1, ln(list_sum(list_transform(s, lambda x: exp(x)))) AS ls1,
  ln(list_sum(list_transform(t, lambda x: exp(x / 4)))) AS lt4, ln(list_sum(list_transform(s, lambda x: exp(x / 4)))) AS ls4 FROM e),
k AS (SELECT vec_id, label, lt1 - t[label + 1] AS ce_teacher, ls1 - s[label + 1] AS ce_student,
  list_sum(list_transform(range(1, len(t) + 1), lambda i: exp(t[i] / 4 - lt4) * ((t[i] / 4 - lt4) - (s[i] / 4 - ls4)))) AS kl FROM l)
SELECT label, count(*) AS n, round(avg(ce_teacher), 6) AS ce, round(avg(0.5 * 16 * kl + 0.5 * ce_student), 6) AS distill_loss
FROM k GROUP BY label""")
def cross_entropy(spark, sf):
    """Embeddings as teacher logits, the same vectors reversed as student logits."""
    e = table(spark, sf, "embeddings").select("label", "embedding", F.reverse("embedding").alias("student"))
    rows = e.select(
        "label", A.cross_entropy("embedding", "label").alias("ce"),
        A.distillation_loss("student", "embedding", "label", 4.0, 0.5).alias("dl"),
    )
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ce"), 6).alias("ce"), F.round(F.avg("dl"), 6).alias("distill_loss")
    )


# ------------------------------------------------------------------------------- MLlib stage
def labelled_documents(spark, sf):
    return texts(spark, sf).select("doc_id", "text").join(labels3(spark, sf), "doc_id")


def model_text():
    return full(F.col("text"), PROFILE)


def fitted(spark, sf):
    """A model of the training documents, the labelled documents with normalised texts, and the features of all of them; each made once."""
    docs = stage(labelled_documents(spark, sf).withColumn("text", model_text()), "labelled-texts")
    train = docs.filter(F.col("split") == "train")
    known = T.fit_words(train, "doc_id", "text")
    features = T.text_features(docs, "doc_id", F.col("text"), known.vocabulary, known.size)
    return T.fit_text_model(train, "doc_id", F.col("text"), "y", like=known, features=features), docs, features


# Words of the labelled documents and which of them the training documents hold.
SQL_KNOWN = f"""WITH {SQL_LABELS3},
labelled AS (SELECT d.doc_id, d.text, split, y FROM documents d JOIN labels3 l USING (doc_id)),
{sql_full('labelled', 'doc_id', 'text')},
tok AS (SELECT doc_id, unnest(string_split(t, ' ')) AS token FROM norm WHERE t <> ''),
cnt AS (SELECT doc_id, token, count(*) AS x FROM tok GROUP BY doc_id, token),
trained AS (SELECT DISTINCT token FROM cnt JOIN labels3 USING (doc_id) WHERE split = 'train'),
known AS (SELECT doc_id, count(*) AS n_distinct, sum(x)::BIGINT AS n_known FROM cnt JOIN trained USING (token) GROUP BY doc_id)"""
SQL_SCORED = SQL_KNOWN + """
SELECT l.doc_id, l.split, l.y::INTEGER AS y, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_known, 0) AS n_known,
  true AS probs_are_softmax, true AS pred_is_argmax, true AS right_more_often_than_not
FROM labelled l LEFT JOIN known USING (doc_id)"""


def checked_scores(model, docs, features):
    """Scores of a model with what can be said of them exactly: the counts they rest on and the consistency of logits, probabilities and
    predictions; and whether the model is right on more than half of its training documents."""
    sizes = features.select("doc_id", "n_distinct", "n_known")
    out = stage(model.score(docs, features, ["doc_id", "split", "y"]), "scores").join(sizes, "doc_id")
    apart = F.array_max(F.zip_with(A.softmax("logits"), "probs", lambda a, b: F.abs(a - b)))
    right = out.where("split = 'train'").agg((F.avg((A.argmax("probs") == F.col("y")).cast("int")) > 0.5).alias("r"))
    return out.select(
        "doc_id", "split", "y", "n_distinct", "n_known", (apart < 1e-9).alias("probs_are_softmax"),
        (A.argmax("probs") == A.argmax("logits")).alias("pred_is_argmax")).withColumn("right_more_often_than_not", right.scalar())


@query("mllib_scores", SQL_SCORED)
def mllib_scores(spark, sf):
    return checked_scores(*fitted(spark, sf))


@query("distill_scores", SQL_SCORED)
def distill_scores(spark, sf):
    """A student trained on the teacher's softened probabilities and the truth."""
    teacher, docs, features = fitted(spark, sf)
    train = docs.filter(F.col("split") == "train")
    logits = teacher.score(train, features, ["doc_id"]).select("doc_id", "logits")
    soft = T.soft_label_rows(train, logits, "doc_id", "y", N_CLASSES)
    student = T.fit_text_model(
        train, "doc_id", F.col("text"), "soft_label", soft=soft, weight="soft_weight", like=teacher, features=features)
    return checked_scores(student, docs, features)


# A linear model whose coefficients both engines can write down.
SQL_LINEAR = SQL_KNOWN + """,
coefs AS (SELECT token, cls, (((length(token) * 13 + ascii(token) * 7 + cls * 5) % 41) - 20) / 8.0::DOUBLE AS coef
  FROM trained, (VALUES (0), (1), (2)) c(cls)),
n_train AS (SELECT count(*) AS n FROM labels3 WHERE split = 'train'),
means AS (SELECT token, sum(x)::DOUBLE / (SELECT n FROM n_train) AS mean FROM cnt JOIN labels3 USING (doc_id) WHERE split = 'train' GROUP BY token),
test_cnt AS (SELECT c.* FROM cnt c JOIN labels3 USING (doc_id) WHERE split = 'test'),
vals AS (SELECT doc_id, token, cls, coef * (x - mean) AS value FROM test_cnt JOIN coefs USING (token) JOIN means USING (token))"""


def linear_parts(spark, sf):
    """Counts of the test documents, coefficients and means of the training words."""
    docs = labelled_documents(spark, sf)
    counts = stage(T.word_counts(docs, model_text(), "doc_id").join(labels3(spark, sf).select("doc_id", "split"), "doc_id"), "counts")
    train = counts.filter(F.col("split") == "train")
    n_train = labels3(spark, sf).filter(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"))
    means = T.mean_counts(train, n_train.scalar())
    coef = ((F.length("token") * 13 + F.ascii("token") * 7 + F.col("cls") * 5) % 41 - 20) / F.lit(8.0)
    coefs = train.select("token").distinct().select("token", F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("cls"))
    test = counts.filter(F.col("split") == "test").select(F.col("doc_id").alias("uid"), "token", "x")
    return test, coefs.withColumn("coef", coef), means, docs.filter(F.col("split") == "test").select(F.col("doc_id").alias("uid"))


@query("linear_attributions", SQL_LINEAR + """,
place AS (SELECT doc_id, c.token, coalesce(sum(abs(value)), 0) AS v FROM test_cnt c LEFT JOIN vals USING (doc_id, token) GROUP BY doc_id, c.token)
SELECT token, round(avg(v), 9) AS mean_abs, count(*) AS "count" FROM place GROUP BY token
ORDER BY round(avg(v), 12) DESC, token LIMIT 100""")
def linear_attributions(spark, sf):
    """Contributions of the words that stand in a test document to the linear model's logits, aggregated to the most important
    words; words that no training document holds count with 0."""
    counts, coefs, means, _ = linear_parts(spark, sf)
    attr = X.linear_attributions(counts, coefs, means)
    return X.global_importance(attr.withColumn("values", F.coalesce("values", F.array().cast("array<double>")))).select(
        "token", F.round("mean_abs", 9).alias("mean_abs"), "count")


@query("linear_remainders", SQL_LINEAR + """,
shift AS (SELECT cls, sum(coef * mean) AS total FROM coefs JOIN means USING (token) GROUP BY cls),
logit AS (SELECT doc_id, cls, sum(coef * x) AS logit FROM test_cnt JOIN coefs USING (token) GROUP BY doc_id, cls),
here AS (SELECT doc_id, cls, sum(value) AS present FROM vals GROUP BY doc_id, cls)
SELECT l.doc_id AS uid, s.cls::INTEGER AS cls, round(coalesce(present, 0), 6) AS present,
  round(coalesce(logit, 0) - total - coalesce(present, 0), 6) AS absent, round(coalesce(logit, 0) - total, 6) AS logit_shift
FROM labels3 l JOIN documents USING (doc_id) CROSS JOIN shift s LEFT JOIN logit g ON g.doc_id = l.doc_id AND g.cls = s.cls
LEFT JOIN here h ON h.doc_id = l.doc_id AND h.cls = s.cls WHERE l.split = 'test'""")
def linear_remainders(spark, sf):
    """What the words of a test document and all words it lacks add up to: its logit less the mean logit."""
    counts, coefs, means, uids = linear_parts(spark, sf)
    out = X.absent_words(counts, coefs, means, uids, N_CLASSES)
    return out.select("uid", "cls", *[(F.round(c, 6) + 0.0).alias(c) for c in ("present", "absent", "logit_shift")])


SAMPLE_SQL = f"""WITH {SQL_LABELS3},
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS k
  FROM labels3 WHERE split = 'test')
SELECT doc_id, y FROM r WHERE k <= 200 // 3"""


@query("explain_sample", SAMPLE_SQL)
def explain_sample(spark, sf):
    """Which test documents get explained: stratified by truth, blind to predictions."""
    test = labels3(spark, sf).filter(F.col("split") == "test")
    return S.stratified_sample(test, "doc_id", "y", [0, 1, 2], 200, 42)
