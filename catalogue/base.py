"""Registry, table access and the SQL fragments several statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import ANY_SCRIPT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROFILE = ANY_SCRIPT
SEED = 42


def query(name: str, sql: str | None = None):
    """Register a query, with the equivalent SQL when there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name)


# ----------------------------------------------------------------- text normalisation in SQL
SQL_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL_URL = rf"https?://[^{SQL_WS}]+|www\.[^{SQL_WS}]+"
SQL_MENTION = r"@[\p{L}\p{N}_]+"
SQL_SYMBOLS = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}"
    r"\x{FE00}-\x{FE0F}\x{200D}\x{20E3}]"
)
SQL_MIN_SYMBOLS = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
)

# Latin texts spelled with Arabic letters, so that the Arabic profile has something to do.
LATIN = "abcdefghijklmnopqrstuvwxyzé"
SPELLED = (
    "أبتثإجحخىدذلمن"
    "آرزسشةئؤَـیکٱ"
)


def sql_replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"


def sql_full_body(expr: str, arabic: bool = False) -> str:
    """Everything before the run collapse."""
    t = expr if arabic else f"lower({expr})"
    t = sql_replace(t, SQL_URL, " ")
    t = sql_replace(t, SQL_MENTION, " ")
    t = f"replace({t}, '#', ' ')"
    t = sql_replace(t, SQL_SYMBOLS, " ")
    if arabic:
        t = sql_replace(t, r"[\x{064B}-\x{0652}\x{0670}\x{06D6}-\x{06ED}]", "")
        t = sql_replace(t, r"[\x{0622}\x{0623}\x{0625}\x{0671}]", "ا")
        t = sql_replace(t, r"[\x{0649}\x{0626}]", "ي")
        t = f"replace(replace({t}, 'ة', 'ه'), 'ـ', '')"
    return t


def sql_spell(expr: str) -> str:
    return f"translate(lower({expr}), '{LATIN}', '{SPELLED}')"


def spell(col: str) -> Column:
    return F.translate(F.lower(F.col(col)), LATIN, SPELLED)


def sql_full(source: str, id_col: str, expr: str, arabic: bool = False, name: str = "norm") -> str:
    """CTEs ending in ``name(id_col, t)``: the fully normalised text.

    RE2 has no back-references, so runs are collapsed character by character: a character goes
    when it equals its left neighbour and the run it is in has at least three of them.
    """
    letters = r"\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}-\x{06D3}" if arabic else r"\p{L}"
    return f"""
{name}_body AS (SELECT {id_col}, string_split({sql_full_body(expr, arabic)}, '') AS l FROM {source}),
{name} AS (
  SELECT {id_col}, trim(regexp_replace(array_to_string(list_filter(l, lambda c, i:
    NOT (c <> chr(10) AND coalesce(c = l[i - 1], false)
         AND (coalesce(c = l[i - 2], false) OR coalesce(c = l[i + 1], false)))), ''),
    '[^{letters}]+', ' ', 'g')) AS t
  FROM {name}_body)"""


def sql_keys(source: str, id_col: str, expr: str = "text", extra: str = "", name: str = "keys") -> str:
    """CTEs ending in ``keys(id_col, uid, raw_sha256, is_empty, extra...)``."""
    more = f", {extra}" if extra else ""
    return (
        sql_full(source, id_col, expr, name=f"{name}_n")
        + f""",
{name} AS (
  SELECT s.{id_col}, sha256(t) AS uid, sha256({expr}) AS raw_sha256, t = '' AS is_empty{more}
  FROM {source} s JOIN {name}_n USING ({id_col}))"""
    )


def sql_minimal(expr: str) -> str:
    t = sql_replace(expr, SQL_URL, "")
    t = sql_replace(t, SQL_MENTION, "")
    t = f"replace({t}, '#', '')"
    t = sql_replace(t, r"[\x{0625}\x{0623}\x{0622}]", "ا")
    t = sql_replace(t, SQL_MIN_SYMBOLS, "")
    return f"trim({sql_replace(t, f'[{SQL_WS}]+', ' ')})"


STOP_WORDS = ("the", "and", "of", "that", "was", "is", "la", "le", "und", "der", "de", "en")


def sql_bag(expr: str) -> str:
    t = sql_replace(
        expr,
        r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\x{F7}\x{D7}\x{A6}"
        r"\x{061B}\x{0640}\x{060C}\x{061F}\x{2026}\x{2013}\x{064B}-\x{0652}]", "",
    )
    for old, new in (("[إأآ]", "ا"), ("ى", "ي"),
                     ("[ؤئ]", "ء"), ("ة", "ه"), ("گ", "ك")):
        t = sql_replace(t, old, new)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        f"coalesce(array_to_string(list_filter(regexp_split_to_array({t}, '[{SQL_WS}]+'), "
        f"lambda w: w <> '' AND NOT list_contains([{stop}], w)), ' '), '')"
    )


# -------------------------------------------------------------------- derived prediction table
SYSTEMS = ("m0", "m1", "m2", "m3")
SEEDS = (42, 43, 44)
N_CLASSES = 3

SQL_LABELS3 = """
labels3 AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS y,
    CASE WHEN substr(md5(concat(CAST(doc_id AS VARCHAR), ':42')), 1, 1) IN ('0', '1', '2') THEN 'test'
         WHEN substr(md5(concat(CAST(doc_id AS VARCHAR), ':42')), 1, 1) IN ('3', '4', '5') THEN 'val'
         ELSE 'train' END AS split
  FROM labels)"""

SQL_PREDICTIONS = SQL_LABELS3 + """,
weights_of AS (
  SELECT concat('m', CAST(k AS VARCHAR)) AS system, sd AS seed, split, doc_id AS uid, y,
    1 + (CASE WHEN y = 0 THEN 40 + 5 * k ELSE 0 END) + ((doc_id * 31 + k * 17 * 1 + sd * 7) % 101) AS w0,
    1 + (CASE WHEN y = 1 THEN 40 + 5 * k ELSE 0 END) + ((doc_id * 31 + k * 17 * 2 + sd * 7 + 37) % 101) AS w1,
    1 + (CASE WHEN y = 2 THEN 40 + 5 * k ELSE 0 END) + ((doc_id * 31 + k * 17 * 3 + sd * 7 + 74) % 101) AS w2
  FROM labels3, (VALUES (0), (1), (2), (3)) s(k), (VALUES (42), (43), (44)) r(sd)),
preds AS (
  SELECT system, seed, split, uid, y,
    w0::DOUBLE / (w0 + w1 + w2) AS p0, w1::DOUBLE / (w0 + w1 + w2) AS p1, w2::DOUBLE / (w0 + w1 + w2) AS p2,
    CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS pred
  FROM weights_of)"""


def labels3(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{SEED}"))), 1, 1)
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("y"),
        F.when(digit.isin("0", "1", "2"), "test").when(digit.isin("3", "4", "5"), "val")
        .otherwise("train").alias("split"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table derived from ``labels``: 4 systems x 3 seeds per labelled document."""
    runs = F.array(*[
        F.struct(F.lit(s).alias("system"), F.lit(k).alias("k"), F.lit(sd).alias("seed"))
        for k, s in enumerate(SYSTEMS) for sd in SEEDS
    ])
    rows = labels3(spark, sf_dir).select("doc_id", "y", "split", F.inline(runs))
    weight = [
        F.lit(1) + F.when(F.col("y") == c, 40 + 5 * F.col("k")).otherwise(0)
        + (F.col("doc_id") * 31 + F.col("k") * 17 * (c + 1) + F.col("seed") * 7 + 37 * c) % 101
        for c in range(N_CLASSES)
    ]
    weighed = rows.select("system", "seed", "split", F.col("doc_id").alias("uid"), "y", F.array(*weight).alias("w"))
    total = F.get("w", F.lit(0)) + F.get("w", F.lit(1)) + F.get("w", F.lit(2))
    return weighed.select(
        "system", "seed", "split", "uid", "y",
        F.transform("w", lambda v: v.cast("double") / total).alias("probs"),
    )
