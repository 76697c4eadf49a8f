"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.functions.staging import fresh_path
from labelloom.llm import (
    contamination, jaccard_join, licenses, main_text, merkle, mixing, quality, ranked_search, repeats, secrets, token_files, top_inner, url_templates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this machine's folders import the package from where it stands; on other
    machines it has to be installed or sent with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digest(spark, path)


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


ORACLES["op6_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('doc0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM s),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  sum(weight) OVER () AS weights, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - filled) / (weights - gone) AS level FROM f),
m AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS lowest FROM l),
t AS (SELECT source, no, source_size, CAST(ceil(n_docs / 512.0) AS BIGINT) AS n_blocks,
  coalesce(least(cap, lowest * weight), cap) AS target FROM m),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS passes FROM t),
x AS (SELECT d.doc_id, d.size, d.key, g.*, target - passes * source_size AS rest,
  CAST('0x' || substr(key, 1, 8) AS BIGINT) % n_blocks AS block FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT no, block, sum(size) AS block_size, md5('block0:' || no || ':' || block) AS turn FROM x GROUP BY no, block),
p AS (SELECT no, block, coalesce(sum(block_size) OVER (PARTITION BY no ORDER BY turn, block
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_before FROM b),
y AS (SELECT x.*, p.block_before + coalesce(sum(size) OVER (PARTITION BY x.no, x.block ORDER BY key, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM x JOIN p ON x.no = p.no AND x.block = p.block)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE
  size * (passes + CASE WHEN words_before + size / 2.0 <= rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM y
"""


URL_RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


@query
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that ends a path names the document a page shows, whose quality label it bears."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("url_label_key"), F.col("quality").alias("good"))
    judged = url_templates.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                         quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def _joined(spans):
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op4_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLES["op4_top_inner"] = """
WITH e AS (SELECT vec_id, [CAST(floor(256.0 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    label = lambda spans: F.transform(spans, lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(label("base")).alias("base_labels"),
        joined(F.concat(label("base"), label("found"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", "source", merkle.record([*fields, F.col("text")]).alias("leaf"),
                       merkle.record([*fields, F.coalesce(tampered, F.col("text"))]).alias("found"))
    proven = merkle.prove(rows, carry=["found"])
    folded = proven.withColumn("folded", merkle.fold(F.col("carry.found"), F.col("steps")))
    hexed = merkle.hexed
    return folded.select(
        F.col("id").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op2_repeats"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, u.s AS s, array_to_string(w[u.s : u.s + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS u(s)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) x WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, u.p AS p FROM later, unnest(range(s, s + 20)) AS u(p)),
word AS (SELECT doc_id, u.p AS p, w[u.p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[u.s : u.s + 2], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(s)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_FRAMED = "coalesce(strlen({0}) || ':' || {0}, '-')"
_FIELDS = " || ".join(_FRAMED.format(c) for c in (
    "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))

ORACLES["op13_merkle_manifest"] = rf"""
WITH RECURSIVE c AS (
  SELECT *, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x:
      [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda s, e:
      CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, (s & 1) * 3988292384) END, 4294967295::BIGINT) AS crc
  FROM documents),
h AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_FRAMED.format("text")}) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256({_FIELDS} || {_FRAMED.format("replace(text, chr(10), '')")})
      ELSE sha256({_FIELDS} || {_FRAMED.format("text")}) END AS found FROM c),
d AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM h),
up AS (
  SELECT t, 0 AS level, i, n, leaf AS digest FROM d
  UNION ALL
  SELECT t, level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY t, level, i // 3),
sub AS (SELECT t, digest AS subroot, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, t AS i, n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3),
node AS (SELECT * FROM up UNION ALL SELECT -1, level, i, n, digest FROM top),
beside AS (
  SELECT a.t, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM node a LEFT JOIN node b ON a.t = b.t AND a.level = b.level AND a.i // 3 = b.i // 3 AND a.i <> b.i
  WHERE a.n > 1 GROUP BY a.t, a.level, a.i),
walk AS (
  SELECT d.t AS own, d.i AS leaf_i, d.t, 0 AS level, d.i, d.n, '' AS proof, found AS folded FROM d
  UNION ALL
  SELECT own, leaf_i, CASE WHEN w.n > 1 THEN w.t ELSE -1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.i // 3 ELSE w.t END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE (SELECT max(n) FROM sub) END,
    CASE WHEN w.n > 1 THEN proof || l || r ELSE proof END, CASE WHEN w.n > 1 THEN sha256(l || folded || r) ELSE folded END
  FROM walk w LEFT JOIN beside b ON w.t = b.t AND w.level = b.level AND w.i = b.i WHERE w.n > 1 OR w.t >= 0)
SELECT d.doc_id, d.leaf, sub.subroot, top.digest AS root, sha256(walk.proof) AS proof_sha256, walk.folded AS folded_root,
  walk.folded = top.digest AS verified
FROM d JOIN sub ON d.t = sub.t JOIN walk ON walk.own = d.t AND walk.leaf_i = d.i AND walk.t = -1 AND walk.n = 1
  JOIN top ON top.n = 1
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op11_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
q AS (SELECT q, item_id, unnest(t) AS term FROM i),
x AS (
  SELECT q, item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
