"""Word index fitted on a training partition, and fixed-length encoding of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import stage
from labelloom.operators.ranking import exact_rank

# Fixed value: the 33 characters that separate words besides the blank.
FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
#: Positions in a text are 32-bit integers.
PLACES = 1 << 31
#: Row numbers below this share a 64-bit integer with a position.
ROWS = 1 << 32


def tokens(text: Column | str) -> Column:
    """Lower-cased words; the filter characters and the blank separate, nothing else does."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(F.translate(t, FILTERS, " " * len(FILTERS)), " "), lambda w: w != "")


def fit_vocabulary(df: DataFrame, text: Column | str, row_no: str) -> DataFrame:
    """``(word, n, first_row, first_pos, idx)``: most frequent first, ties by first appearance.

    The place of first appearance is one number, so the word counts are plain hash aggregates and
    frequent words shrink to one record per task: an integer where the row numbers (read in a job of their own)
    leave room for the position, a decimal elsewhere.  The counts are written once (a job), since ranking reads them
    more than once and the texts should be read once.
    """
    reach = df.agg(F.min(F.col(row_no).cast("long")).alias("low"), F.max(F.col(row_no).cast("long")).alias("high")).first()
    words = df.select(F.col(row_no).cast("long").alias("_row"), F.posexplode(tokens(text)).alias("pos", "word"))
    if reach.low is None or 0 <= reach.low and reach.high < ROWS:
        place = F.shiftleft("_row", 31) + F.col("pos")
        first_row, first_pos = F.shiftright("_first", 31), F.col("_first").bitwiseAND(F.lit(PLACES - 1))
    else:
        wide = F.lit(PLACES).cast("decimal(10,0)")
        place = F.col("_row").cast("decimal(20,0)") * wide + F.col("pos")
        first_row = F.floor(F.col("_first") / wide).cast("long")
        first_pos = (F.col("_first") - first_row.cast("decimal(20,0)") * wide).cast("long")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"))
    counted = counted.select("word", "n", first_row.alias("first_row"), first_pos.alias("first_pos"))
    ranked = exact_rank(
        stage(counted, "word-counts"),
        partition=[],
        levels=[-F.col("n"), F.shiftright("first_row", 20), F.shiftright("first_row", 10)],
        order=[F.col("first_row"), F.col("first_pos")],
        name="idx",
    )
    return ranked.select("word", "n", "first_row", "first_pos", "idx")


def vocabulary_size(vocabulary: DataFrame, num_words: int) -> DataFrame:
    return vocabulary.agg(
        F.least(F.count(F.lit(1)) + 1, F.lit(num_words).cast("long")).alias("vocab_size")
    )


def encode(
    df: DataFrame, id_col: str, text: Column | str, vocabulary: DataFrame, num_words: int, max_len: int,
    out: str = "ids",
) -> DataFrame:
    """``(id, out)``: word indices per text.  Unknown words and indices >= ``num_words`` are dropped, the last
    ``max_len`` stay, zeros pad on the left.

    The words meet the index in a join that Spark plans by its size; every task then trims what it holds of a
    text to ``max_len`` places before the texts are put together, so no more than that is gathered anywhere.
    ``id_col`` tells the rows apart.
    """
    known = vocabulary.filter(F.col("idx") < num_words).select("word", F.col("idx").cast("int").alias("idx"))
    places = df.select(id_col, F.posexplode(tokens(text)).alias("pos", "word"))
    found = places.join(known, "word").select(id_col, "pos", "idx")
    back = Window.partitionBy(id_col).orderBy(F.desc("pos"))
    tail = found.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= max_len)
    rows = tail.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_tail"))
    ids = F.coalesce(F.transform("_tail", lambda p: p["idx"]), F.array().cast("array<int>"))
    padded = F.concat(F.array_repeat(F.lit(0), F.lit(max_len) - F.coalesce(F.size("_tail"), F.lit(0))), ids)
    return df.select(id_col).join(rows, id_col, "left").select(id_col, padded.alias(out))
