"""Benchmark decontamination by word windows and canonical templates.

Method.  Windows of ``k`` words of the benchmark are joined by hash with those of the documents, in two ways.
*Word for word*: lower-case words as they stand; an item of fewer than ``k`` words is one window as long as itself.
*By template*: numbers, names (capitalised words inside a sentence) and units after a number are typed placeholders; a capitalised word
that opens a sentence and is a name elsewhere in its text counts both as a name and as an ordinary word;
windows with fewer than ``min_literal`` ordinary words are left out on the benchmark's side.  Where a matching
window holds slots that changed, the values must map consistently along the alignment of document and item: a value that
stands more than once and is changed everywhere tells of it, and more than half of such slots have to agree
with what most slots of their value became; then only the windows of the others are left out.  A re-parameterised question changes its
values consistently, an accident does not.
An item is found in a document when ``min_share`` of its windows match in either way, or when ``run`` or more of its
words stand there one after another.

Everything is DataFrame expressions.  The windows of the documents are never shuffled as long as the
benchmark's windows, which are counted first, number at most ``broadcast_rows``; beyond that the
join shuffles the hashes.  Texts meet only the few matches with slots again.  A document has one window for each word, and
two where it holds a slot.

Edge cases: null and empty texts have no windows; windows without a letter match nothing, so tables of numbers are
no copies and items of numbers alone are never found; an item of one or two words is found in every document that
holds them; changed values are looked for in items of ``k`` words or more; repeated items are reported each, rows sharing an id are
one document; documents with
a null id are found under the null id; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let
from labelloom.functions.staging import stage
from labelloom.llm.graph import sized, without

#: Marks of the placeholders for numbers, names and units.
MARKS = "#@~"
#: The look behind stands after the capital, so it is only tried there.
NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;:][ \t\r\n].)\p{Ll}+"
#: A capitalised word that is no NAME where it stands, as at the start of a sentence.
OPENING = r"\p{Lu}(?<![\p{L}\p{M}\p{N}@].)\p{Ll}++(?![\p{L}\p{M}])"
UNITS = (
    "mm|cm|m|km|mg|g|kg|t|ml|cl|l|s|sec|secs|seconds|min|mins|minutes|h|hr|hrs|hours|days|weeks|months|years|"
    "inch|inches|ft|feet|yards|miles|mph|oz|lb|lbs|pounds|percent|eur|usd|euros|dollars|cents|degrees|w|kw|kwh|v|hz"
)


SPLIT = rf"[^\p{{L}}\p{{M}}{MARKS}0-9]+"
LONG = 1 << 30


def canonical(text: Column, keep_values: bool = False) -> Column:
    """Template words of a text; with ``keep_values`` each placeholder is followed by its value."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARKS}]", " ")
    t = F.regexp_replace(t, NAME, " @$0 " if keep_values else " @ ")
    return F.array_remove(F.split(F.lower(_numbers(t, keep_values)), SPLIT), "")


def _numbers(t: Column, keep_values: bool) -> Column:
    t = F.regexp_replace(t, rf"([0-9]+) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", " #$1 ~$2 " if keep_values else " # ~ ")
    return F.regexp_replace(t, "(?<![#0-9])[0-9]+" if keep_values else "[0-9]+", " #$0 " if keep_values else " # ")


def valued(text: Column) -> Column:
    """Words of ``canonical`` with values; ``~@`` marks those that open a sentence and are names elsewhere in the text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARKS}]", " ")
    t = F.regexp_replace(t, NAME, " @$0 ")
    t = F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, OPENING, " ~@$0 ")).otherwise(t)
    found = F.array_remove(F.split(F.lower(_numbers(t, True)), SPLIT), "")

    def known(words: Column) -> Column:
        names = F.array_distinct(F.filter(words, lambda w: w.startswith("@")))
        opening = F.array_distinct(F.transform(F.filter(words, lambda w: w.startswith("~@")), lambda w: F.substring(w, 2, LONG)))
        return let(F.array_intersect(opening, names), lambda both: F.transform(words, lambda w: F.when(
            w.startswith("~@") & ~F.array_contains(both, F.substring(w, 2, LONG)), F.substring(w, 3, LONG)).otherwise(w)))

    return let(found, known)


def _opened(values: Column, names: bool) -> Column:
    """Words of ``valued`` in which opening names are names or ordinary words."""
    return F.transform(values, lambda w: F.when(w.startswith("~@"), F.substring(w, 2 if names else 3, LONG)).otherwise(w))


def plain_words(text: Column) -> Column:
    """Lower-case words of a text as they stand; digits and letters are parted as in a template."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", " $0 ")
    return F.array_remove(F.split(t, r"[^\p{L}\p{M}0-9]+"), "")


def _is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(*MARKS)


def _template(values: Column) -> Column:
    """Template words of the words that ``canonical`` gives with their values."""
    return F.transform(values, lambda w: F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w))


def _all_starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def _starts_around(words: Column, k: int, wanted) -> Column:
    """Starts of the windows that hold a word for which ``wanted`` is true."""
    places = F.filter(F.transform(words, lambda w, i: F.when(wanted(w), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.sequence(F.greatest(i - (k - 1), F.lit(0)), F.least(i, F.size(words) - k)))
    return F.when(F.size(words) >= k, F.array_distinct(F.flatten(around))).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, k: int, starts: Column, template: Column | None = None, named: bool = False) -> Column:
    """``pos, hash, template, named`` of the runs of ``k`` words at ``starts``.  ``words`` should be a column, not an expression."""
    template = F.lit(False) if template is None else template
    value = F.transform(words, lambda w: F.xxhash64(w))
    bound = F.transform(F.array(F.struct(value.alias("v"), starts.alias("s"))), lambda x: F.transform(
        x["s"], lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(x["v"], i + 1, F.lit(k))).alias("hash"), template.alias("template"),
                                    F.lit(named).alias("named"))))
    return F.element_at(bound, 1)


def _slots(words: Column) -> Column:
    return F.filter(words, _is_slot)


def _template_windows(k: int) -> list[Column]:
    """Windows of the template ``words``, and of ``named_words`` where an opening name makes a difference."""
    opening = _starts_around(F.col("valued"), k, lambda w: w.startswith("~@"))
    return [_windows(F.col("words"), k, _all_starts(F.col("words"), k), F.lit(True)),
            _windows(F.col("named_words"), k, opening, F.lit(True), True)]


def benchmark_windows(benchmark: DataFrame, *, item_col: str, text_col: str, k: int, min_literal: int) -> DataFrame:
    """``item_id, literal, ipos, hash, len, slots, usable``: windows of each item, word for word and by template, and how
    many it has of that kind."""
    texts = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    words = texts.select("item_id", plain_words(F.col("text")).alias("words"))
    words = words.withColumn("len", F.least(F.size("words"), F.lit(k))).where("len > 0")
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))).alias("hash"),
                             F.lit(False).alias("template"), F.lit(False).alias("named")))
    own = F.when(F.col("len") < k, whole).otherwise(_windows(F.col("words"), k, _all_starts(F.col("words"), k)))
    plain = words.select("item_id", "words", "len", F.inline(own)).where(
        F.exists(F.slice("words", F.col("pos") + 1, F.col("len")), lambda w: ~w.rlike("^[0-9]")))
    plain = plain.select("item_id", F.lit(True).alias("literal"), F.col("pos").alias("ipos"), "hash", "len",
                         F.array().cast("array<string>").alias("slots"))
    words = texts.select("item_id", valued(F.col("text")).alias("valued"))
    words = words.select("item_id", "valued", _opened(F.col("valued"), False).alias("plain"), _opened(F.col("valued"), True).alias("named_"))
    words = words.select("*", _template(F.col("plain")).alias("words"), _template(F.col("named_")).alias("named_words"))
    each = words.select("item_id", "plain", "named_", F.inline(F.concat(*_template_windows(k))))
    each = each.withColumn("values", F.when(F.col("named"), F.col("named_")).otherwise(F.col("plain")))
    each = each.withColumn("slots", _slots(F.slice("values", F.col("pos") + 1, F.lit(k)))).where(F.size("slots") <= k - min_literal)
    each = each.select("item_id", F.lit(False).alias("literal"), F.col("pos").alias("ipos"), "hash", F.lit(k).alias("len"), "slots")
    each = plain.unionByName(each).distinct()
    usable = each.groupBy(F.col("item_id").alias("u_item"), F.col("literal").alias("u_literal")).agg(
        F.countDistinct("ipos").alias("usable"))
    same = F.col("item_id").eqNullSafe(F.col("u_item")) & (F.col("literal") == F.col("u_literal"))
    return each.join(usable, same).drop("u_item", "u_literal")


def document_windows(texts: DataFrame, k: int, lengths: list[int]) -> DataFrame:
    """``doc_id, row, pos, hash, template, named``: all windows of ``lengths`` words as they stand and, of texts that hold a slot,
    those of ``k`` template words.  In a text without slots the former are template windows too."""
    slotted = F.col("text").rlike(rf"[0-9{MARKS}]|{NAME}")
    values = F.when(slotted, valued(F.col("text"))).otherwise(F.array().cast("array<string>"))
    words = texts.select("doc_id", "row", plain_words(F.col("text")).alias("plain"), values.alias("valued"))
    words = words.withColumn("words", _template(_opened(F.col("valued"), False))).withColumn(
        "named_words", _template(_opened(F.col("valued"), True)))
    both = F.size("valued") == 0
    seen = [_windows(F.col("plain"), n, _all_starts(F.col("plain"), n), both) for n in lengths]
    return words.select("doc_id", "row", F.inline(F.concat(*seen, *_template_windows(k))))


def _found_literally(hits: DataFrame, k: int, min_share: float, run: int) -> DataFrame:
    """Items found word for word."""
    need = max(run - k, 0)  # a run of windows holds k - 1 words more than windows
    aligned = hits.where("literal").groupBy("doc_id", "row", "item_id", "usable", "shift").agg(
        F.array_sort(F.collect_set("ipos")).alias("ipos"))
    # Sorted distinct positions: those ``need`` places apart that differ by ``need`` enclose a run.
    unbroken = F.exists(F.transform("ipos", lambda p, i: F.get("ipos", i + need) - p == need), lambda x: x)
    found = aligned.groupBy("doc_id", "item_id", "usable").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ipos")))).cast("long").alias("windows"),
        F.max((F.size("ipos") > need) & F.coalesce(unbroken, F.lit(False)) & (F.col("usable") > need)).alias("unbroken"))
    return found.select("doc_id", "item_id", "usable", "windows", F.lit(False).alias("changed"),
                        (F.col("unbroken") | (F.col("windows") >= F.col("usable") * min_share)).alias("found"))


def _judged(pairs: Column) -> Column:
    """``at, b, d, agrees, repeated`` of the slots ``at, b, d`` of an alignment.

    A slot agrees when its value is unchanged or more than half of the slots with its value in the benchmark
    hold the same in the document.  It tells of consistency (``repeated``) when that value stands more than once and is changed everywhere.
    """
    def one(p: Column, all_pairs: Column) -> Column:
        same = F.filter(all_pairs, lambda q: q["b"] == p["b"])
        alike = F.filter(all_pairs, lambda q: (q["b"] == p["b"]) & (q["d"] == p["d"]))
        kept = F.exists(all_pairs, lambda q: (q["b"] == p["b"]) & (q["d"] == p["b"]))
        return F.struct(p["at"].alias("at"), p["b"].alias("b"), p["d"].alias("d"),
                        ((p["b"] == p["d"]) | (2 * F.size(alike) > F.size(same))).alias("agrees"),
                        ((F.size(same) > 1) & ~kept).alias("repeated"))

    return let(pairs, lambda all_pairs: F.transform(all_pairs, lambda p: one(p, all_pairs)))


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", k: int = 8, min_literal: int = 5,
         min_share: float = 0.5, run: int = 13, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``doc_id, item_id, windows, usable, changed``: items found, with the number of their windows that match and that
    could match (by template where enough do, else in the way in which the larger share does), and whether
    any slot holds another value than in the benchmark."""
    items = stage(benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, k=k, min_literal=min_literal),
                  "benchmark-windows")
    small = F.broadcast(items) if items.count() <= broadcast_rows else items
    lengths = sorted({r.len for r in items.select("len").distinct().collect()} | {k})  # at most k
    # Rows that share an id are told apart by their text.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    seen = document_windows(texts, k, lengths)
    hits = stage(seen.join(small, "hash").select(
        "doc_id", "row", "item_id", "literal", "ipos", "usable", "pos", (F.col("pos") - F.col("ipos")).alias("shift"), "slots", "template", "named"), "hits")
    literal = _found_literally(hits, k, min_share, run)

    hits = hits.where("not literal")
    plain = hits.where(F.size("slots") == 0).select("doc_id", "item_id", "usable", "ipos", F.lit(False).alias("changed"), "template")
    slotted = hits.where(F.size("slots") > 0)
    # Written, so that its own size and not that of all matches decides whether the texts are shuffled.
    wanted = sized(stage(slotted.select(F.col("doc_id").alias("w_id"), F.col("row").alias("w_row")).distinct(), "slotted"))
    same_row = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))
    known = texts.join(wanted, same_row).select("w_id", "w_row", valued(F.col("text")).alias("values")).distinct()
    own = F.slice("values", F.col("pos") + 1, F.lit(k))
    own = F.when(F.col("named"), _opened(own, True)).otherwise(_opened(own, False))
    places = F.transform(own, lambda w, i: F.struct((F.col("ipos") + i).alias("at"), w.alias("d")))
    places = F.filter(places, lambda x: _is_slot(x["d"]))
    pairs = F.zip_with("slots", places, lambda b, x: F.struct(x["at"].alias("at"), b.alias("b"), x["d"].alias("d")))
    aligned = slotted.join(known, same_row).select(
        "doc_id", "row", "item_id", "usable", "ipos", "shift", pairs.alias("pairs"))
    aligned = aligned.groupBy("doc_id", "row", "item_id", "usable", "shift").agg(
        F.collect_list(F.struct("ipos", "pairs")).alias("seen"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    aligned = aligned.withColumn("pairs", _judged(F.col("pairs")))
    known = F.filter("pairs", lambda p: p["repeated"])
    trusted = 2 * F.size(F.filter("pairs", lambda p: p["repeated"] & p["agrees"])) > F.size(known)
    aligned = aligned.withColumn("trusted", trusted | (F.size(known) == 0)).withColumn(
        "clashing", F.transform(F.filter("pairs", lambda p: ~p["agrees"]), lambda p: F.struct(p["at"].alias("at"), p["b"].alias("b"), p["d"].alias("d"))))
    differs = lambda p: p["b"] != p["d"]
    consistent = aligned.withColumn("changed", F.col("trusted") & F.exists("pairs", differs)).select(
        "doc_id", "item_id", "usable", "trusted", "clashing", "changed", F.inline("seen"))
    agrees = F.col("trusted") & ~F.arrays_overlap("pairs", "clashing")
    consistent = consistent.where(agrees | ~F.exists("pairs", differs)).select(
        "doc_id", "item_id", "usable", "ipos", "changed", F.lit(True).alias("template"))
    # A window without slots also matches words that are names in the document; the reported number leaves these out.
    found = plain.unionByName(consistent).groupBy("doc_id", "item_id", "usable").agg(
        F.countDistinct(F.when(F.col("template"), F.col("ipos"))).alias("windows"), F.countDistinct("ipos").alias("folded"),
        F.max("changed").alias("changed"))
    found = found.withColumn("first", F.col("windows") >= F.col("usable") * min_share).withColumn(
        "found", F.col("folded") >= F.col("usable") * min_share).drop("folded")
    found = found.unionByName(literal.withColumn("first", F.lit(False))).groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("windows", "usable"), F.struct("first", F.col("windows") / F.col("usable"))).alias("best"),
        F.max("changed").alias("changed"), F.max("found").alias("found"))
    return found.where("found").select("doc_id", "item_id", "best.windows", F.col("best.usable").cast("long").alias("usable"), "changed")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    found = find(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct()
    return without(docs, stage(found, "contaminated"), id_col)
