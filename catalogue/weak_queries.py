"""Lexicon signals, the forty rules, majority and weighted votes, and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import SEED, SQL_WS, query, table, texts
from labelloom.functions.staging import fresh_path, stage
from labelloom.operators import weak
from labelloom.operators.lexicon import lexicon_signals
from labelloom.operators.rules import LABEL_NAMES, LEXICONS, NEUTRAL, RULES, apply_rules, votes_long
from labelloom.operators.term_join import with_list_counts
from labelloom.sources.corpora import read_json_lines, read_tsv, weak_label_records, weak_label_table, write_tsv

# Neutral syllables of the fixture texts stand in for the user's lexicons.
TERMS = {
    "tribal_slurs": ["thorin", "thheti", "erheit"],
    "tribal_names": ["tionhe", "ouelle"],
    "political_slurs": ["einst", "ciónar"],
    "dehumanizing": ["blehe", "aiment", "hatio"],
    "violence_incitement": ["thonea", "enelle"],
    "profanity": ["enung", "étion", "bleer", "nung"],
    "insults": ["chkeit", "thndnt"],
    "threats": ["menteux", "thanon", "oredble"],
    "news": ["thanea", "lement", "ndble"],
    "humanitarian": ["einver", "sting"],
    "violence_reporting": ["ciónco", "eaing"],
    "war_parties": ["enein", "thanedble"],
    "dialect": ["chsch", "estion"],
    "religious": ["ciónmente", "aterth"],
}
COUNTED = ("tribal_slurs", "dehumanizing", "violence_incitement", "profanity")
NAMES = [r.name for r in RULES]
M = len(RULES)
SHORT = ("ts", "tn", "ps", "dh", "vi", "pf", "ins", "th", "nw", "hm", "vr", "wp", "di", "rl")


def _sql_any(terms):
    return "(" + " OR ".join(f"contains(text, '{t}')" for t in terms) + ")"


def _sql_count(terms):
    return "(" + " + ".join(f"contains(text, '{t}')::INTEGER" for t in terms) + ")"


SQL_WORDS = f"len(list_filter(regexp_split_to_array(text, '[{SQL_WS}]+'), lambda w: w <> ''))"
SQL_SIGNALS = (
    "sig AS (SELECT doc_id, source, lang, text, "
    + ", ".join(f"{_sql_any(TERMS[n])} AS {s}" for n, s in zip(LEXICONS, SHORT))
    + ", " + ", ".join(f"{_sql_count(TERMS[n])} AS c_{s}" for n, s in zip(LEXICONS, SHORT) if n in COUNTED)
    + f", {SQL_WORDS} AS words FROM documents)"
)
SQL_NEG = "(ts OR tn OR ps OR dh OR vi OR pf OR ins OR th OR rl)"
SQL_CTX = "(nw OR vr OR wp OR hm)"
# Votes and conditions spelled out independently of the rule table under test.
SQL_RULES = [
    (0, "ts AND dh"), (0, "ts AND pf"), (0, "ts AND vi"), (0, "ts"), (0, "tn AND dh"),
    (0, "tn AND pf"), (0, "tn AND vi"), (0, "ps AND dh"), (0, "ps AND pf"), (0, "ps AND vi"),
    (0, "vi"), (0, "c_ts >= 2"), (0, "dh AND vi"), (0, "rl AND vi"), (0, "rl AND dh"),
    (0, "th AND (tn OR ts OR ps)"),
    (0, "ts::INTEGER + dh::INTEGER + vi::INTEGER + pf::INTEGER + th::INTEGER >= 3"),
    (0, "dh AND (tn OR ps OR wp)"), (0, "pf AND wp AND ins"),
    (1, "pf AND NOT ts AND NOT tn AND NOT ps"), (1, "ins"), (1, "th AND NOT tn AND NOT ts"),
    (1, "dh AND NOT ts AND NOT tn AND NOT ps"), (1, "pf AND ins"), (1, "rl AND NOT vi AND NOT dh"),
    (1, "c_pf >= 2"), (1, "ps"), (1, "ins AND di"),
    (2, "nw AND NOT pf AND NOT ts AND NOT dh AND NOT ins AND NOT ps"),
    (2, "hm AND NOT pf AND NOT ts AND NOT vi AND NOT dh"), (2, "vr AND nw AND NOT ts AND NOT pf"),
    (2, "wp AND nw AND NOT pf AND NOT ts AND NOT dh"), (2, f"di AND NOT {SQL_NEG}"),
    (2, f"NOT {SQL_NEG} AND (di OR hm)"), (2, f"words <= 8 AND NOT {SQL_NEG} AND NOT {SQL_CTX}"),
    (2, f"hm AND di AND NOT {SQL_NEG}"),
    (2, "vr AND NOT pf AND NOT ts AND NOT dh AND NOT vi AND NOT ins AND NOT ps"),
    (2, "tn AND nw AND NOT pf AND NOT dh AND NOT vi"),
    (0, "nw AND c_ts + c_dh + c_vi >= 2"), (1, "dh AND NOT nw"),
]
SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
SQL_VOTES = SQL_SIGNALS + ",\nvotes AS (SELECT doc_id, source, lang, text, [" + ", ".join(
    f"CASE WHEN {cond} THEN {vote} ELSE -1 END" for vote, cond in SQL_RULES
) + "] AS v FROM sig),\nlong AS (SELECT doc_id, source, lang, u.i AS rule, v[u.i + 1] AS vote FROM votes, unnest(range(0, 40)) AS u(i))"


def _sql_weights(where: str = "", suffix: str = "") -> str:
    return f"""
cov{suffix} AS (
  SELECT rule, count(*) FILTER (WHERE vote >= 0) AS labeled,
    count(*) FILTER (WHERE vote >= 0)::DOUBLE / count(*) AS coverage
  FROM long {where} GROUP BY rule),
w{suffix} AS (
  SELECT rule, labeled, coverage, (1.0::DOUBLE / (coverage + 0.005::DOUBLE))
    / (SELECT sum(1.0::DOUBLE / (coverage + 0.005::DOUBLE) ORDER BY rule) FROM cov{suffix}) * 40.0::DOUBLE AS weight
  FROM cov{suffix})"""


def _sql_weighted(suffix: str = "", name: str = "wv") -> str:
    return f"""
score{suffix} AS (
  SELECT doc_id,
    coalesce(sum(weight ORDER BY l.rule) FILTER (WHERE vote = 0), 0) AS s0,
    coalesce(sum(weight ORDER BY l.rule) FILTER (WHERE vote = 1), 0) AS s1,
    coalesce(sum(weight ORDER BY l.rule) FILTER (WHERE vote = 2), 0) AS s2
  FROM long l JOIN w{suffix} w ON l.rule = w.rule GROUP BY doc_id),
{name} AS (
  SELECT doc_id,
    CASE WHEN s0 + s1 + s2 = 0 THEN 2 WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS wv_label,
    CASE WHEN s0 + s1 + s2 = 0 THEN 0.0::DOUBLE ELSE greatest(s0, s1, s2) / (s0 + s1 + s2) END AS wv_conf,
    CASE WHEN s0 + s1 + s2 = 0 THEN 1 ELSE 0 END AS wv_novote
  FROM score{suffix})"""


SQL_MAJORITY = """
tally AS (SELECT doc_id, vote, count(*) AS k, min(rule) AS first FROM long WHERE vote >= 0 GROUP BY doc_id, vote),
lead_class AS (
  SELECT doc_id, vote, k, sum(k) OVER (PARTITION BY doc_id) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) AS r FROM tally),
mv AS (
  SELECT d.doc_id, coalesce(c.vote, 2) AS mv_label, coalesce(c.k::DOUBLE / c.n, 0.0) AS mv_conf
  FROM documents d LEFT JOIN lead_class c ON d.doc_id = c.doc_id AND c.r = 1)"""

SQL_TRAIN = "WHERE substr(md5(concat(CAST(doc_id AS VARCHAR), ':42')), 1, 1) NOT IN ('0', '1', '2')"
BOTH = f"WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weighted()}, {SQL_MAJORITY}"


def votes_of(spark, sf, keep=("doc_id",)):
    """Votes of all documents as a written table: several passes read it."""
    return stage(apply_rules(texts(spark, sf), "text", TERMS, RULES, list(keep)), "votes")


def _in_train():
    digit = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{SEED}"))), 1, 1)
    return ~digit.isin("0", "1", "2")


def labelled(spark, sf, keep=("doc_id",)):
    both = weak.majority_vote(votes_of(spark, sf, keep), 3, NEUTRAL)
    return weak.fit_and_vote(both, NAMES, 3, NEUTRAL)


@query("lexicon_signals", f"WITH {SQL_SIGNALS} SELECT doc_id, "
       + ", ".join(f"{s} AS has_{n}" for n, s in zip(LEXICONS, SHORT))
       + ", " + ", ".join(f"c_{s} AS n_{n}" for n, s in zip(LEXICONS, SHORT) if n in COUNTED)
       + ", words::INTEGER AS word_count FROM sig")
def lexicon_flags(spark, sf):
    sig = lexicon_signals(texts(spark, sf), "text", TERMS, COUNTED)
    return sig.select("doc_id", *[f"has_{n}" for n in LEXICONS], *[f"n_{n}" for n in LEXICONS if n in COUNTED], "word_count")


TERM_LISTS = ("l0", "l1", "l2", "l3")


@query("lexicon_table_signals", """
WITH words AS (SELECT unnest(string_split(text, ' ')) AS term FROM documents),
terms AS (
  SELECT DISTINCT concat('l', length(term) % 4) AS lexicon, term FROM words
  UNION ALL SELECT concat('l', item_id % 4), substr(text, 1, 4) FROM benchmark
  UNION ALL SELECT 'l0', substr(text, 1, 4) FROM benchmark WHERE item_id = 0),
entries AS (SELECT lexicon, term, count(*) AS times FROM terms GROUP BY lexicon, term),
hits AS (SELECT doc_id, lexicon, sum(times) FILTER (WHERE contains(text, term)) AS n FROM documents CROSS JOIN entries GROUP BY doc_id, lexicon)
SELECT doc_id, """ + ", ".join(
    f"coalesce(max(n) FILTER (WHERE lexicon = '{n}'), 0)::INTEGER AS n_{n}, coalesce(max(n) FILTER (WHERE lexicon = '{n}'), 0) > 0 AS has_{n}"
    for n in TERM_LISTS) + " FROM hits GROUP BY doc_id")
def lexicon_table_signals(spark, sf):
    """Every word of every document is an entry (some hundred thousand), by length; a few more entries, one of them twice."""
    start = F.substring("text", 1, 4).alias("term")
    items, docs = table(spark, sf, "benchmark"), texts(spark, sf)
    words = docs.select(F.explode(F.split("text", " ")).alias("term")).distinct()
    terms = words.select(F.concat(F.lit("l"), F.length("term") % 4).alias("lexicon"), "term").unionByName(
        items.select(F.concat(F.lit("l"), F.col("item_id") % 4).alias("lexicon"), start)).unionByName(
        items.where("item_id = 0").select(F.lit("l0").alias("lexicon"), start))
    return with_list_counts(docs.select("doc_id", "text"), "doc_id", "text", stage(terms, "terms"), TERM_LISTS).drop("text")


@query("lf_votes_long", f"WITH {SQL_VOTES} SELECT doc_id, rule::INTEGER AS rule, {SQL_NAMES}[rule + 1] AS rule_name, "
       "vote::TINYINT AS vote FROM long")
def lf_votes_long(spark, sf):
    votes = apply_rules(texts(spark, sf), "text", TERMS, RULES, ["doc_id"])
    return votes_long(votes, RULES, ["doc_id"])


@query("lf_analysis", f"""WITH {SQL_VOTES}
SELECT rule::INTEGER AS rule, {SQL_NAMES}[rule + 1] AS rule_name, count(*) FILTER (WHERE vote >= 0) AS labeled,
  100.0::DOUBLE * count(*) FILTER (WHERE vote >= 0) / count(*) AS coverage,
  count(*) FILTER (WHERE vote = 0) AS n_hate, count(*) FILTER (WHERE vote = 1) AS n_offensive,
  count(*) FILTER (WHERE vote = 2) AS n_neutral
FROM long GROUP BY rule""")
def lf_analysis(spark, sf):
    votes = apply_rules(texts(spark, sf), "text", TERMS, RULES, ["doc_id"])
    return weak.rule_analysis(votes, NAMES, LABEL_NAMES)


@query("lf_matrix_summary", f"""WITH {SQL_VOTES},
k AS (SELECT doc_id, count(DISTINCT vote) FILTER (WHERE vote >= 0) AS kinds FROM long GROUP BY doc_id)
SELECT count(*) AS n_texts, count(*) FILTER (WHERE kinds > 0) AS any_vote,
  count(*) FILTER (WHERE kinds = 0) AS no_vote, count(*) FILTER (WHERE kinds > 1) AS conflicts FROM k""")
def lf_matrix_summary(spark, sf):
    votes = apply_rules(texts(spark, sf), "text", TERMS, RULES, ["doc_id"])
    return weak.matrix_summary(votes)


@query("majority_vote", f"WITH {SQL_VOTES}, {SQL_MAJORITY} SELECT doc_id, mv_label::INTEGER AS mv_label, "
       "round(mv_conf, 9) AS mv_conf FROM mv")
def majority_vote(spark, sf):
    votes = apply_rules(texts(spark, sf), "text", TERMS, RULES, ["doc_id"])
    return weak.majority_vote(votes, 3, NEUTRAL).select("doc_id", "mv_label", F.round("mv_conf", 9).alias("mv_conf"))


@query("lf_weights", f"""WITH {SQL_VOTES}, {_sql_weights()}
SELECT rule::INTEGER AS rule, {SQL_NAMES}[rule + 1] AS rule_name, labeled, round(coverage, 9) AS coverage,
  round(weight, 9) AS weight FROM w""")
def lf_weights(spark, sf):
    votes = apply_rules(texts(spark, sf), "text", TERMS, RULES, ["doc_id"])
    return weak.rule_weights(votes, NAMES).select(
        "rule", "rule_name", "labeled", F.round("coverage", 9).alias("coverage"), F.round("weight", 9).alias("weight")
    )


_WV = "SELECT doc_id, wv_label::INTEGER AS wv_label, round(wv_conf, 9) AS wv_conf, wv_novote::INTEGER AS wv_novote FROM wv"


def _wv(df):
    return df.select("doc_id", "wv_label", F.round("wv_conf", 9).alias("wv_conf"), "wv_novote")


@query("weighted_vote", f"WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weighted()} {_WV}")
def weighted_vote(spark, sf):
    return _wv(weak.fit_and_vote(votes_of(spark, sf), NAMES, 3, NEUTRAL))


@query("weighted_vote_train_only",
       f"WITH {SQL_VOTES}, {_sql_weights(SQL_TRAIN)}, {_sql_weighted()} {_WV}")
def weighted_vote_train_only(spark, sf):
    return _wv(weak.fit_and_vote(votes_of(spark, sf), NAMES, 3, NEUTRAL, fit_on=_in_train()))


@query("weight_drift", f"""WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weights(SQL_TRAIN, '_t')}
SELECT count(*) AS n_rules, round(max(abs(w_t.weight - w.weight) / w.weight), 9) AS max_abs_rel_diff
FROM w JOIN w_t ON w.rule = w_t.rule""")
def weight_drift(spark, sf):
    votes = votes_of(spark, sf)
    train = weak.rule_weights(votes.filter(_in_train()), NAMES)
    return weak.weight_drift(train, weak.rule_weights(votes, NAMES)).select(
        "n_rules", F.round("max_abs_rel_diff", 9).alias("max_abs_rel_diff")
    )


@query("label_distribution", BOTH + """,
every AS (SELECT 'majority' AS method, mv_label AS label, mv_conf AS conf FROM mv
          UNION ALL SELECT 'weighted', wv_label, wv_conf FROM wv),
grid AS (SELECT * FROM (VALUES ('majority'), ('weighted')) a(method), (VALUES (0, 'HATE'), (1, 'OFFENSIVE'), (2, 'NEUTRAL')) b(label, label_name))
SELECT g.method, g.label::INTEGER AS label, g.label_name, count(e.label) AS n,
  round(100.0::DOUBLE * count(e.label) / (SELECT count(*) FROM documents), 9) AS pct,
  round(coalesce(avg(e.conf), 0), 9) AS mean_conf
FROM grid g LEFT JOIN every e ON g.method = e.method AND g.label = e.label GROUP BY ALL""")
def label_distribution(spark, sf):
    methods = {"majority": ("mv_label", "mv_conf"), "weighted": ("wv_label", "wv_conf")}
    return weak.label_distribution(labelled(spark, sf), methods, LABEL_NAMES).select(
        "method", "label", "label_name", "n", F.round("pct", 9).alias("pct"), F.round("mean_conf", 9).alias("mean_conf")
    )


@query("vote_agreement", BOTH + """
SELECT count(*) AS n, count(*) FILTER (WHERE mv_label = wv_label) AS n_agree,
  round(count(*) FILTER (WHERE mv_label = wv_label)::DOUBLE / count(*), 9) AS agreement
FROM mv JOIN wv USING (doc_id)""")
def vote_agreement(spark, sf):
    return weak.agreement(labelled(spark, sf), "mv_label", "wv_label").withColumn(
        "agreement", F.round("agreement", 9)
    )


@query("review_plan", BOTH + """
SELECT count(*) FILTER (WHERE wv_conf >= 0.8::DOUBLE) AS high,
  count(*) FILTER (WHERE wv_conf >= 0.6::DOUBLE AND wv_conf < 0.8::DOUBLE) AS medium,
  count(*) FILTER (WHERE wv_conf < 0.6::DOUBLE) AS low,
  (count(*) FILTER (WHERE wv_conf < 0.6::DOUBLE)
   + floor(count(*) FILTER (WHERE wv_conf >= 0.6::DOUBLE AND wv_conf < 0.8::DOUBLE) * 0.25))::BIGINT AS effort
FROM wv""")
def review_plan(spark, sf):
    return weak.review_plan(labelled(spark, sf), "wv_conf")


SQL_SPLIT = ("CASE WHEN substr(md5(concat(CAST(doc_id AS VARCHAR), ':42')), 1, 1) IN ('0', '1', '2') "
             "THEN 'test' ELSE 'train' END")


@query("label_flips", f"""WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weighted()},
{_sql_weights(SQL_TRAIN, '_t')}, {_sql_weighted('_t', 'wv_t')},
j AS (SELECT {SQL_SPLIT} AS split, wv.wv_label AS old, wv_t.wv_label AS new FROM wv JOIN wv_t USING (doc_id))
SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (WHERE old <> new) AS weak_changed,
  count(*) FILTER (WHERE (old <= 1) <> (new <= 1)) AS binary_changed
FROM j GROUP BY GROUPING SETS ((split), ())""")
def label_flips(spark, sf):
    votes = votes_of(spark, sf)
    old = weak.fit_and_vote(votes, NAMES, 3, NEUTRAL, prefix="old")
    new = weak.weighted_vote(old, weak.weight_array(votes.filter(_in_train()), M), 3, NEUTRAL, "new")
    df = new.select(
        F.when(_in_train(), "train").otherwise("test").alias("split"), "old_label", "new_label",
        (F.col("old_label") <= 1).alias("old_bin"), (F.col("new_label") <= 1).alias("new_bin"),
    )
    return weak.label_flips(df, "split", {
        "weak_changed": ("old_label", "new_label"), "binary_changed": ("old_bin", "new_bin"),
    })


SQL_STORED = """
stored AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label FROM labels)"""


@query("vote_reproduction", f"""WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weighted()}, {SQL_STORED}
SELECT count(*) AS n, count(*) FILTER (WHERE wv_label = label) AS n_equal, bool_and(coalesce(wv_label = label, false)) AS reproduced
FROM wv FULL JOIN stored USING (doc_id)""")
def vote_reproduction(spark, sf):
    """Labels stored by people beside the labels recomputed from the rules: rows without the one or the other count as not reproduced."""
    again = weak.fit_and_vote(votes_of(spark, sf), NAMES, 3, NEUTRAL)
    people = table(spark, sf, "labels")
    stored = people.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("stored"))
    both = again.select("doc_id", "wv_label").join(stored, "doc_id", "full")
    return weak.reproduction(both, "wv_label", "stored")


@query("vote_reproduction_by_label", f"""WITH {SQL_VOTES}, {_sql_weights()}, {_sql_weighted()}, {SQL_STORED}
SELECT label AS stored, count(*) AS n, count(*) FILTER (WHERE wv_label = label) AS n_equal, bool_and(wv_label = label) AS reproduced
FROM wv JOIN stored USING (doc_id) GROUP BY label""")
def vote_reproduction_by_label(spark, sf):
    """The same for each stored label, over the rows that have one."""
    again = weak.fit_and_vote(votes_of(spark, sf), NAMES, 3, NEUTRAL)
    people = table(spark, sf, "labels")
    stored = people.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("stored"))
    return weak.reproduction(again.select("doc_id", "wv_label").join(stored, "doc_id"), "wv_label", "stored", ["stored"])


@query("weak_label_table", BOTH + """
SELECT CAST(d.doc_id + 1 AS VARCHAR) AS id, md5(regexp_replace(d.text, '[\\t\\n\\r]', ' ', 'g')) AS text_md5, d.source,
  d.lang AS keyword_cat, CAST(wv_label AS VARCHAR) AS weak_label, ['HATE', 'OFFENSIVE', 'NEUTRAL'][wv_label + 1] AS label_name,
  round_even(wv_conf, 3) AS confidence, '' AS human_label
FROM documents d JOIN wv USING (doc_id)""")
def weak_labels(spark, sf):
    """The published layout, written without quoting and read back."""
    # The sink needs the texts: they are read twice (weights, then labels) and never copied.
    docs = texts(spark, sf)
    votes = apply_rules(docs, "text", TERMS, RULES, ["doc_id", "text", "source", "lang"])
    out = weak_label_table(weak.fit_and_vote(votes, NAMES, 3, NEUTRAL), "doc_id", "text", "source", "lang", "wv_label", "wv_conf", LABEL_NAMES)
    path = fresh_path(spark, "weak-labels")
    write_tsv(out, path)
    back = read_tsv(spark, path, out.columns)
    return back.select("id", F.md5("text").alias("text_md5"), "source", "keyword_cat", "weak_label", "label_name",
                       F.col("confidence").cast("double").alias("confidence"), "human_label")


@query("weak_label_records", BOTH + """
SELECT doc_id, mv_label::INTEGER AS weak_label_mv, ['HATE', 'OFFENSIVE', 'NEUTRAL'][mv_label + 1] AS weak_label_mv_name,
  round_even(mv_conf, 3) AS weak_conf_mv, wv_label::INTEGER AS weak_label_wv,
  ['HATE', 'OFFENSIVE', 'NEUTRAL'][wv_label + 1] AS weak_label_wv_name, round_even(wv_conf, 3) AS weak_conf_wv
FROM mv JOIN wv USING (doc_id)""")
def weak_records(spark, sf):
    """The records with both votes, written as JSON and read back."""
    out = weak_label_records(labelled(spark, sf), ["doc_id"], LABEL_NAMES)
    path = fresh_path(spark, "weak-records")
    out.write.json(path)
    return read_json_lines(spark, path, out.schema)
