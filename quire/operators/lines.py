"""Words of a line from its glyphs, and emphasis that nests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(items: DataFrame, keys: list[str], order: str, text: Column, separator: Column) -> DataFrame:
    """(keys, word, text, items): the words of a line whose items are glyphs and, where ``separator`` holds, ends of words.

    A separator ends a word even if that has no glyph, so one at the beginning gives an
    empty first word and two in a row an empty one between; what follows the last one is
    a word if it has any text. ``word`` counts from 0; null texts are empty; a line
    without items has no words.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cut = F.coalesce(separator, F.lit(False))
    rows = items.withColumn("_cut", cut).withColumn("word", F.sum(F.col("_cut").cast("int")).over(w) - F.col("_cut").cast("int")).withColumn("_t", F.when(~F.col("_cut"), F.coalesce(text, F.lit(""))))
    got = rows.groupBy(*keys, F.col("word").cast("int").alias("word")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_t").alias("t"))))), lambda r: r["t"]), "").alias("text"),
        F.count("_t").alias("items"), F.bool_or("_cut").alias("_ended"),
    )
    return got.where(F.col("_ended") | (F.col("text") != "")).drop("_ended")


def nested_emphasis(runs: DataFrame, keys: list[str], order: list[str], bold: Column, italic: Column) -> DataFrame:
    """``mark``, what stands before a run where bold (``**``) or italic (``*``) begins or
    ends, and ``close``, what closes all behind the last run of the keys.

    Of two that are on, the one that began first is the outer one; of two that begin at
    one run, bold. To end the outer one, the inner one is closed and opened again. What is
    on follows from the run alone, and which is the outer one from where their stretches
    began, so windows do without a fold.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = runs.withColumns({"_b": F.coalesce(bold, F.lit(False)), "_i": F.coalesce(italic, F.lit(False)), "_n": F.row_number().over(w)})
    rows = rows.withColumns({"_pb": F.coalesce(F.lag("_b").over(w), F.lit(False)), "_pi": F.coalesce(F.lag("_i").over(w), F.lit(False)), "_last": F.lead("_n").over(w).isNull()})
    since = lambda now, before: F.last(F.when(F.col(now) & ~F.col(before), F.col("_n")), ignorenulls=True).over(w)
    rows = rows.withColumns({"_sb": since("_b", "_pb"), "_si": since("_i", "_pi")})
    # where the stretches before this run began
    rows = rows.withColumns({"_lb": F.lag("_sb").over(w), "_li": F.lag("_si").over(w)})
    b, i, pb, pi = (F.col(c) for c in ("_b", "_i", "_pb", "_pi"))
    first = F.when(b & ~pb, "**").when(~b & pb, F.when(pi & (F.col("_lb") <= F.col("_li")), "*" + "**" + "*").otherwise("**")).otherwise("")
    # bold is on by now if it is on here; it is inside if it began later, so too if it began just now
    second = F.when(i & ~pi, "*").when(~i & pi, F.when(b & (~pb | (F.col("_li") < F.col("_lb"))), "**" + "*" + "**").otherwise("*")).otherwise("")
    close = F.when(~F.col("_last"), "").when(b & i, F.when(F.col("_sb") <= F.col("_si"), "*" + "**").otherwise("**" + "*")).when(b, "**").when(i, "*").otherwise("")
    return rows.withColumns({"mark": F.concat(first, second), "close": close}).drop("_b", "_i", "_n", "_pb", "_pi", "_last", "_sb", "_si", "_lb", "_li")
