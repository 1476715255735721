"""Search hits in a page's text, and the runs that they touch."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import small_batches


def offsets(runs: DataFrame, keys: list[str], order: list[str], separator: Column) -> DataFrame:
    """``start`` and ``stop``: the code points of a run in its page's text, in which ``separator`` stands behind each run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.length("text") + F.length("_sep")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return runs.withColumn("_sep", separator).withColumn("start", before).withColumn("stop", F.col("start") + F.length("text"))


def _matches(text: str, words: list[str]) -> Column:
    """(word, z): for each word that a text holds the pieces ``p`` before its matches ``m``, and these."""
    if not words or any(re.match(f"(?:{w})$", "") for w in words):
        raise ValueError("a word to look for is needed, and none that matches nothing")
    parts = []
    for word in dict.fromkeys(words):
        pattern = f"(?i){word}"
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        parts.append(F.when(F.col(text).rlike(pattern), F.struct(F.lit(word).alias("word"), zipped.alias("z"))))
    return F.array_compact(F.array(*parts))


def hits(texts: DataFrame, keys: list[str], text: str, words: list[str]) -> DataFrame:
    """(keys, word, pos, len) of every match of the words, as patterns and in either case, in each text.

    Matches of one word don't overlap, and none is empty; those of different words may
    overlap. ``pos`` counts code points from 0. The pieces between the matches and the
    matches themselves come from the same pattern, so their lengths add up to the places.
    """
    rows = texts.select(*keys, F.explode(_matches(text, words)).alias("_w"))
    rows = rows.select(*keys, "_w.word", F.posexplode("_w.z").alias("_i", "_z")).where("_z.m <> ''")
    end = F.sum(F.length("_z.p") + F.length("_z.m")).over(Window.partitionBy(*keys, "word").orderBy("_i"))
    return rows.select(*keys, "word", (end - F.length("_z.m")).cast("long").alias("pos"), F.length("_z.m").alias("len"))


def _places(starts: pa.Array, stops: pa.Array, words: pa.Array, steps: pa.Array, sizes: pa.Array) -> pa.Array:
    """For each hit of a page its place, the first run that it touches and how many these are.

    ``steps``: a hit's own code points and those between it and the one before; ``words``
    numbers the words, as a word's first hit counts from the text's beginning.
    """
    at = words.value_lengths().to_numpy()
    word, step, size = (x.flatten().to_numpy() for x in (words, steps, sizes))
    page, run = np.repeat(np.arange(len(at)), at), np.repeat(np.arange(len(at)), starts.value_lengths().to_numpy())
    end = np.cumsum(step)
    opens = np.concatenate(([True], (word[1:] != word[:-1]) | (page[1:] != page[:-1])))[: len(end)]
    before = (end - step)[opens]
    pos = end - before[np.cumsum(opens) - 1] - size if len(end) else end
    # a page's places lie behind all those of the pages before it
    whole = int(max([1, *(x.max() + 1 for x in (pos + size, stops.flatten().to_numpy()) if len(x))]))
    first = np.searchsorted(stops.flatten().to_numpy() + run * whole, pos + page * whole, "right")
    behind = np.searchsorted(starts.flatten().to_numpy() + run * whole, pos + size - 1 + page * whole, "right")
    runs_before = np.concatenate(([0], np.cumsum(starts.value_lengths().to_numpy())))[page]
    out = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (pos, first - runs_before, np.maximum(behind - first, 0))], names=["pos", "first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(at))), pa.int32()), out)


def highlights(runs: DataFrame, keys: list[str], order: list[str], words: list[str], separator: Column) -> DataFrame:
    """(keys, word, pos, len, runs, x0, y0, x1, y1): each hit in a page's text with the runs that it touches and the box around them.

    ``runs`` needs text, x, y, width and font_size; ``separator`` is what stands between
    a run and the next one and may depend on the run. ``runs`` in the result counts them;
    ``from`` and ``to`` are the offsets where the first begins and the last ends. A hit that
    lies in a separator alone touches none and has a null box. A null text is an empty
    run; an empty table gives an empty result. With a null among the keys, no run is touched.

    A page's runs are gathered once, for its text and for its hits, which find theirs by
    binary search, so nothing is joined: one exchange by page, or none if there was one.
    """
    placed = offsets(runs.withColumn("text", F.coalesce("text", F.lit(""))), keys, order, separator)
    held = F.array_sort(F.collect_list(F.struct("start", "stop", "text", "_sep", "x", "y", "width", "font_size")))
    pages = placed.groupBy(*keys).agg(held.alias("_runs"))
    pages = pages.withColumn("_text", F.array_join(F.transform("_runs", lambda r: F.concat(r["text"], r["_sep"])), ""))
    # a run without characters touches nothing, so intervals of characters are closed ones
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    parts = F.transform(F.filter("_runs", lambda r: known & (r["stop"] > r["start"])), lambda r: F.struct(*[r[c].alias(c) for c in ("start", "stop", "x", "y", "width", "font_size")]))
    found = F.transform(_matches("_text", words), lambda w, i: F.transform(F.filter(w["z"], lambda z: z["m"] != ""), lambda z: F.struct(w["word"].alias("word"), i.alias("i"), (F.length(z["p"]) + F.length(z["m"])).cast("long").alias("step"), F.length(z["m"]).alias("len"))))
    pages = pages.select(*keys, parts.alias("_runs"), F.flatten(found).alias("_m")).where("size(_m) > 0")
    places = F.arrow_udf(_places, "array<struct<pos:long,first:long,n:long>>")
    small_batches(runs.sparkSession)
    pages = pages.withColumn("_at", places("_runs.start", "_runs.stop", "_m.i", "_m.step", "_m.len"))
    hit = F.transform("_m", lambda m, i: F.struct(m["word"].alias("word"), F.get("_at", i)["pos"].alias("pos"), m["len"].alias("len"), F.slice("_runs", F.get("_at", i)["first"].cast("int") + 1, F.get("_at", i)["n"].cast("int")).alias("r")))
    rows = pages.select(*keys, F.explode(hit).alias("_h")).select(*keys, "_h.word", "_h.pos", "_h.len", F.col("_h.r").alias("_r"))
    return rows.select(
        *keys, "word", "pos", "len", F.size("_r").cast("long").alias("runs"), F.array_min("_r.start").alias("from"), F.array_max("_r.stop").alias("to"),
        F.array_min("_r.x").alias("x0"), F.array_min("_r.y").alias("y0"), F.array_max(F.transform("_r", lambda r: r["x"] + r["width"])).alias("x1"), F.array_max(F.transform("_r", lambda r: r["y"] + r["font_size"])).alias("y1"),
    )
