"""URL filter: rules first, then a path-template tree for each host.

Method.  Digits of a path become ``#``; equal shapes of a host are counted once, with the good
and bad labels of their pages.  The tree is built level by level from the host down.  Below one
template, a segment with fewer than ``min_support`` pages is variable and joins the wildcard
``*``; the others are ordered by their share of bad labels, and each joins the branch before it as long as it does not differ
from any member (two-proportion test, ``z`` below ``similar``).  The largest merged branch is the wildcard.
Segments from ``depth`` on form one last segment.  A template is rejected when its share of good labels,
smoothed by its host's share and that by the share of all labels, is below ``purity``.

Everything is DataFrame expressions.  Pages are aggregated by host and shape before any join; the
way back joins on (host, shape, salt), so a host or shape with a third of all pages is spread
over ``salts`` keys.
  Siblings are compared by their distinct pairs of good and bad labels, in one row for each
template; the comparisons grow with the square of these pairs in one branch.

Edge cases: a null url or one without ``://`` has an empty host and path and takes part as such;
repeated pages count as often as they stand there; pages without labels only add support; an
empty table gives an empty result; null page ids are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.arrays import let
from labelloom.functions.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, null when none does."""
    text = verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, action).otherwise(verdict)
    return text, verdict


def _merged(child: DataFrame, similar: float) -> DataFrame:
    """``host, template, part, branch`` for well-supported segments below each template.

    Segments are put in order of their share of bad labels; one that differs significantly from any member of the
    branch before it begins the next branch.  The branch with most pages is the wildcard.
    """
    siblings = Window.partitionBy("host", "template")
    c = child.withColumn("seen", F.col("good") + F.col("bad")).withColumn("share", F.col("bad") / F.col("seen"))
    c = c.withColumn("kind", F.struct("share", "seen", "bad"))
    kinds = c.select("host", "template", "kind").distinct().groupBy("host", "template").agg(
        F.array_sort(F.collect_list("kind")).alias("kinds"))

    def differ(x: Column, y: Column) -> Column:
        pooled = (x["bad"] + y["bad"]) / (x["seen"] + y["seen"])
        spread = pooled * (1 - pooled) * (1 / x["seen"] + 1 / y["seen"])
        apart = x["share"] - y["share"]
        return (spread > 0) & (apart * apart >= similar * similar * spread)

    def add(state: Column, x: Column) -> Column:
        begins = F.exists(state["branch"], lambda y: differ(x, y))
        return let(begins, lambda new: F.struct(
            F.when(new, F.array(x)).otherwise(F.concat(state["branch"], F.array(x))).alias("branch"),
            F.when(new, F.concat(state["cuts"], F.array(x))).otherwise(state["cuts"]).alias("cuts")))

    empty = F.array().cast("array<struct<share:double,seen:bigint,bad:bigint>>")
    cuts = kinds.select("host", "template", F.aggregate(
        "kinds", F.struct(empty.alias("branch"), empty.alias("cuts")), add, lambda state: state["cuts"]).alias("cuts"))
    c = c.join(cuts, ["host", "template"]).withColumn("group", F.size(F.filter("cuts", lambda x: x <= F.col("kind"))))
    together = Window.partitionBy("host", "template", "group")
    c = c.withColumn("pages", F.sum("n").over(together)).withColumn("parts_in", F.count(F.lit(1)).over(together))
    c = c.withColumn("main", F.max(F.struct(F.col("pages"), (-F.col("group")).alias("g"))).over(siblings))
    name = F.when(F.col("group") == -F.col("main.g"), "*").when(F.col("parts_in") == 1, F.col("part")).otherwise(
        F.concat(F.lit("*"), F.col("group").cast("string")))
    return c.select("host", "template", "part", name.alias("branch"))


def rejected_shapes(shapes: DataFrame, *, depth: int, min_support: int, similar: float, purity: float,
                    prior: float) -> DataFrame:
    """``host, shape, template, rejected`` for ``host, shape, n, good, bad``."""
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    nodes = stage(shapes.select("*", parts.alias("parts"), F.lit("").alias("template")), "url-shapes")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    for level in range(depth):
        rest = F.concat_ws("/", F.slice("parts", level + 1, F.greatest(F.size("parts"), F.lit(1))))
        last = F.when(F.size("parts") > level, rest)
        part = last if level == depth - 1 else F.get("parts", level)
        nodes = nodes.withColumn("part", part)
        child = nodes.groupBy("host", "template", "part").agg(*sums)
        branch = child.join(_merged(child.where((F.col("n") >= min_support) & (F.col("good") + F.col("bad") > 0)), similar),
                            ["host", "template", "part"], "left")
        branch = branch.select(F.col("host").alias("b_host"), F.col("template").alias("b_template"),
                               F.col("part").alias("b_part"), F.coalesce("branch", F.lit("*")).alias("branch"))
        same = (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template"))
        deeper = F.concat("template", F.lit("/"), "branch")
        nodes = nodes.join(branch, same & F.col("part").eqNullSafe(F.col("b_part"))).select(
            "host", "shape", "n", "good", "bad", "parts",
            F.when(F.col("part").isNull(), F.col("template")).otherwise(deeper).alias("template"))
        nodes = stage(nodes, f"url-level{level}")  # each level reads the one before three times
    total = nodes.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 1)).alias("share"))
    smooth = lambda base: (F.sum("good") + prior * base) / (F.sum("good") + F.sum("bad") + prior)
    hosts = nodes.groupBy("host").agg(smooth(total.scalar()).alias("host_share"))
    leaves = nodes.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    kept = leaves.join(hosts, "host").select(
        "host", "template",
        ((F.col("good") + prior * F.col("host_share")) / (F.col("good") + F.col("bad") + prior) < purity).alias("rejected"))
    return nodes.select("host", "shape", "template").join(kept, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], *, id_col: str = "page_id",
          url_col: str = "url", depth: int = 4, min_support: int = 20, similar: float = 1.96,
          purity: float = 0.6, prior: float = 10.0, salts: int = 32) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` for every row of ``pages``.

    ``labels`` has ``url_label_key`` (see ``label_key``) and ``good`` (1, 0 or null).
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    marked = labels.groupBy(F.col("url_label_key")).agg(F.min("good").alias("low"), F.max("good").alias("high"))
    marked = marked.where("low = high").select("url_label_key", F.col("low").alias("good"))
    # Counted before the join, so that pages without a number are one row for each shape.
    counted = rows.groupBy("host", "shape", label_key(F.col("path")).alias("url_label_key")).agg(F.count(F.lit(1)).alias("n"))
    shapes = counted.join(marked, "url_label_key", "left").groupBy("host", "shape").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("bad"))
    shapes = rejected_shapes(shapes, depth=depth, min_support=min_support, similar=similar, purity=purity, prior=prior)
    salted = shapes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(salted, ["host", "shape", "salt"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template")


def label_key(path: Column) -> Column:
    """The number at the end of a path, null without one: what page labels are looked up by."""
    return F.regexp_extract(path, r"([0-9]+)(\.[a-z]+)?/?$", 1).try_cast("bigint")
