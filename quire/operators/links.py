"""The text under a link's area."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small_batches


def url_texts(links: DataFrame, runs: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``links`` (keys, ord, x0, y0, x1, y1, uri) with ``text``, what stands in their area, and ``runs``, of how many runs.

    Areas and runs (keys, x, y, text, seq) are in a page's own coordinates, upwards from
    its foot. They are compared downwards from its head, where an area holds its left and
    top edges and not the others; on a turned page (``pages``: keys, height, rotate) the area's upper
    edge is taken as it is. Text is put together from left to right, line by line, as far
    as runs with one y are lines. An area without runs has an empty text; links without
    URI, area or page are left out; runs that several areas hold count for each. ``pages``
    has one row a page.

    A page, its runs and its links are gathered in one group and not joined, so what is
    dealt by a key already stays where it is. An area searches the page's runs for its
    band and looks at those alone.
    """
    links = links.where("uri IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    known = links.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    number = lambda c: F.col(c).cast("double")
    sides = {
        "_r": runs.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, F.struct(number("y").alias("y"), number("x").alias("x"), "seq", "text").alias("_r")),
        "_l": known.select(*keys, F.struct(*known.columns).alias("_l")),
        "_p": pages.select(*keys, F.struct("height", "rotate").alias("_p")),
    }
    kinds = {c: side.schema[c].dataType for c, side in sides.items()}
    both = reduce(DataFrame.union, [side.select(*keys, *[F.col(c) if c == own else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]) for own, side in sides.items()])
    page = both.groupBy(*keys).agg(F.collect_list("_r").alias("_r"), F.collect_list("_l").alias("_l"), F.first("_p", ignorenulls=True).alias("_p")).where("size(_l) > 0 AND _p IS NOT NULL")
    high = F.col("_p.height")
    top = lambda r: F.when(F.col("_p.rotate") == 0, high - r["y1"]).otherwise(r["y1"]).cast("double")
    area = F.transform("_l", lambda r: F.struct(r.alias("row"), r["x0"].cast("double").alias("rx"), top(r).alias("ry"), (r["x1"] - r["x0"]).cast("double").alias("rw"), (r["y1"] - r["y0"]).cast("double").alias("rh")))
    page = page.withColumn("_a", area)
    # a page's runs from its head downwards, from left to right
    down = F.array_sort(F.transform("_r", lambda r: F.struct((high.cast("double") - r["y"]).alias("y"), r["x"].alias("x"), r["seq"].alias("seq"), r["text"].alias("text"))))
    page = page.select("_a", down.alias("_r"))
    small_batches(runs.sparkSession)
    held = F.arrow_udf(_held, "array<array<int>>")
    page = page.withColumn("_in", held("_r.y", "_r.x", "_a.rx", "_a.ry", "_a.rw", "_a.rh"))
    found = F.transform("_a", lambda a, i: F.struct(a["row"].alias("row"), F.transform(F.get("_in", i), lambda k: F.get("_r", k)).alias("r")))
    rows = page.select(F.explode(found).alias("_f")).select("_f.row.*", F.size("_f.r").cast("long").alias("runs"), F.filter("_f.r", lambda r: r["text"].isNotNull()).alias("_r"))
    apart = F.transform("_r", lambda r, i: F.concat(F.when(i == 0, "").when(F.get("_r", i - 1)["y"] == r["y"], " ").otherwise("\n"), r["text"]))
    return rows.withColumn("text", F.array_join(apart, "")).drop("_r")


def _held(ys: pa.Array, xs: pa.Array, rx: pa.Array, ry: pa.Array, rw: pa.Array, rh: pa.Array) -> pa.Array:
    """For each area of a page the numbers of its runs, which come by y, that the area holds: those of its band, by x."""
    out = []
    y, x, *box = (c.flatten().to_numpy() for c in (ys, xs, rx, ry, rw, rh))
    at = areas = 0
    for n, m in zip(ys.value_lengths().to_pylist(), rx.value_lengths().to_pylist()):
        here, across, found = y[at : at + n], x[at : at + n], []
        left, top, wide, high = (c[areas : areas + m] for c in box)
        low, high = np.searchsorted(here, top, "right"), np.searchsorted(here, top + high, "right")
        for i, j, a, b in zip(low.tolist(), high.tolist(), left.tolist(), (left + wide).tolist()):
            band = across[i:j]
            found.append((np.flatnonzero((band >= a) & (band < b)) + i).tolist())
        out.append(found)
        at, areas = at + n, areas + m
    return pa.array(out, pa.list_(pa.list_(pa.int32())))
