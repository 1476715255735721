"""Joins of boxes and intervals by a grid of cells in several widths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.trees import checkpoints

#: Widths of a cell, from fine to coarse; what is larger than SPAN of the coarsest lies in one cell with all others of its keys.
WIDTHS = (64.0, 512.0, 4096.0)
#: A box lies in cells of the least width of which it covers no more than this many in a row.
SPAN = 4


def _level(sides: list[tuple[Column, Column]], widths: tuple[float, ...]) -> Column:
    extent = F.greatest(*[hi - lo for lo, hi in sides]) if len(sides) > 1 else sides[0][1] - sides[0][0]
    level = F.lit(len(widths))
    for k in reversed(range(len(widths))):
        level = F.when(extent <= SPAN * widths[k], k).otherwise(level)
    return level


def _place(value: Column, level: Column, widths: tuple[float, ...]) -> Column:
    """The number of the cell of a level that holds a value; 0 on the level that has but one."""
    out = F.lit(0).cast("long")
    for k, w in enumerate(widths):
        out = F.when(level == k, F.floor(value / w)).otherwise(out)
    return out


def _sides(side: str, ends: list[tuple[str, str]]) -> list[tuple[Column, Column]]:
    return [tuple(F.col(f"_{side}_{x}").cast("double") for x in pair) for pair in ends]


def _cells(rows: DataFrame, ends: list[tuple[str, str]], widths: tuple[float, ...], side: str, used: list[int] | None = None) -> DataFrame:
    """The rows under names of their side, for each of their cells on their own level and all coarser ones, or those ``used``.

    Bounds and levels are derived again behind a join, so that it carries the columns alone,
    and these aren't in a struct, so that the rows' partitioning stays known.
    """
    held = rows.select(*[F.col(c).alias(f"_{side}_{c}") for c in rows.columns])
    sides = _sides(side, ends)
    held = held.where(reduce(lambda a, b: a & b, [lo <= hi for lo, hi in sides]))
    own = _level(sides, widths)
    levels = F.sequence(own, F.lit(len(widths)))
    held = held.withColumn(f"_{side}_level", F.explode(levels if used is None else F.filter(levels, lambda v: (v == own) | v.isin(used))))
    for i, ends_ in enumerate(sides):
        held = held.withColumn(f"_{side}_at{i}", F.explode(F.sequence(*[_place(x, F.col(f"_{side}_level"), widths) for x in ends_])))
    return held


def met(left: DataFrame, right: DataFrame, keys: list[str], left_ends: list[tuple[str, str]], right_ends: list[tuple[str, str]], widths: tuple[float, ...] = WIDTHS, few: str = "") -> DataFrame:
    """Each pair that meets, once, its columns under ``_l_`` and ``_r_``.

    ``few``: the side ("l" or "r") with far fewer rows. It is checkpointed, and the other
    one's rows are only made for their own level and those on which it has boxes: mostly one.
    """
    used = {}
    if few:
        checkpoints(left)
        rows, ends = (left, left_ends) if few == "l" else (right, right_ends)
        rows = rows.checkpoint()
        levels = rows.select(_level([tuple(F.col(x).cast("double") for x in pair) for pair in ends], widths).alias("v")).distinct()
        used = {"r" if few == "l" else "l": sorted(r.v for r in levels.collect() if r.v is not None)}  # a number for each width and one more at most
        left, right = (rows, right) if few == "l" else (left, rows)
    a, b = _cells(left, left_ends, widths, "l", used.get("l")), _cells(right, right_ends, widths, "r", used.get("r"))
    same = [*keys, "level", *[f"at{i}" for i in range(len(left_ends))]]
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"_l_{k}") == F.col(f"_r_{k}") for k in same]))
    mine, theirs = _sides("l", left_ends), _sides("r", right_ends)
    meets = F.greatest(_level(mine, widths), _level(theirs, widths)) == F.col("_l_level")
    for i, (p, q) in enumerate(zip(mine, theirs)):
        low = F.greatest(p[0], q[0])
        meets &= (low <= F.least(p[1], q[1])) & (_place(low, F.col("_l_level"), widths) == F.col(f"_l_at{i}"))
    return both.where(meets).select(*[F.col(f"_l_{c}") for c in left.columns], *[F.col(f"_r_{c}") for c in right.columns])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_sides: list[tuple[str, str]], right_sides: list[tuple[str, str]], widths: tuple[float, ...] = WIDTHS, few: str = "") -> DataFrame:
    """Each pair of a left and a right row with equal keys whose boxes meet, once, as structs ``l`` and ``r``.

    A box is a pair of columns for each dimension, its ends included; a point has equal
    ends. Null keys equal nothing, boxes with a null, NaN or reversed end meet nothing.
    ``few`` ("l" or "r") names the side with far fewer rows, which is then checkpointed.

    Two boxes meet on the level of the larger one: a row stands in the cells that it covers
    on its own level, a few by the level's choice, and on all coarser ones, and only the
    cell that holds the lower ends of the overlap returns the pair, so nothing is
    made twice. The join is on equal keys, level and cell, which Spark can broadcast, hash,
    sort and split where skewed; no row meets a whole table or page, but boxes hundreds of
    cells wide meet all of their keys.
    """
    got = met(left, right, list(keys), left_sides, right_sides, widths, few)
    return got.select(*[F.struct(*[F.col(f"_{s}_{c}").alias(c) for c in rows.columns]).alias(s) for s, rows in (("l", left), ("r", right))])


def in_regions(runs: DataFrame, regions: DataFrame, keys: list[str] = (), few: str = "") -> DataFrame:
    """Runs with each region (rx, ry, rw, rh; others) of their keys that holds their corner (x, y).

    Left and top edges belong to a region, right and bottom ones do not; a run in several
    regions comes with each. Without keys the regions hold for all runs; a handful of
    them should come under ``broadcast``, and no run is shuffled. ``few``: as above.
    """
    boxes = regions.select("*", (F.col("rx") + F.col("rw")).alias("_x"), (F.col("ry") + F.col("rh")).alias("_y"))
    got = met(runs, boxes, list(keys), [("x", "x"), ("y", "y")], [("rx", "_x"), ("ry", "_y")], WIDTHS, few)
    held = (F.col("_l_x") < F.col("_r__x")) & (F.col("_l_y") > F.col("_r_ry"))
    rest = [c for c in regions.columns if c not in keys]
    return got.where(held).select(*[F.col(f"_l_{c}").alias(c) for c in runs.columns], *[F.col(f"_r_{c}").alias(c) for c in rest])


def first_region(runs: DataFrame, row: list[str], regions: DataFrame, order: str, keys: list[str] = ()) -> DataFrame:
    """Every run with ``order`` of the first of the regions that hold it, null where none does; ``row`` names a run.

    The regions are gathered by cell, and a run looks its own cell up on each level that
    has regions, so it is never copied, grouped or joined with itself; under ``broadcast``
    it stays where it is.
    """
    boxes = regions.select(*keys, F.struct(order, "rx", "ry", (F.col("rx") + F.col("rw")).alias("_x"), (F.col("ry") + F.col("rh")).alias("_y")).alias("_b"))
    boxes = boxes.where("_b.rx <= _b._x AND _b.ry <= _b._y")
    ends = [tuple(F.col(f"_b.{x}").cast("double") for x in pair) for pair in (("rx", "_x"), ("ry", "_y"))]
    boxes = boxes.withColumn("_level", _level(ends, WIDTHS))
    for i, pair in enumerate(ends):
        boxes = boxes.withColumn(f"_at{i}", F.explode(F.sequence(*[_place(x, F.col("_level"), WIDTHS) for x in pair])))
    cells = boxes.groupBy(*keys, "_level", "_at0", "_at1").agg(F.collect_list("_b").alias("_bs"))
    levels = sorted(r[0] for r in boxes.select("_level").distinct().collect())  # a number for each width and one more at most
    got, found = runs, []
    for v in levels:
        at = [F.floor(F.col(c).cast("double") / WIDTHS[v]) if v < len(WIDTHS) else F.when(F.col(c).isNotNull(), 0) for c in ("x", "y")]
        here = cells.where(F.col("_level") == v).select(*keys, "_at0", "_at1", F.col("_bs").alias(f"_bs{v}"))
        here = F.broadcast(here) if not keys else here  # what holds for every page is a template of a page
        got = got.withColumns({f"_at{i}": x.cast("long") for i, x in enumerate(at)}).join(here, [*keys, "_at0", "_at1"], "left").drop("_at0", "_at1")
        x, y = F.col("x"), F.col("y")
        holds = lambda b: (x >= b["rx"]) & (x < b["_x"]) & (y > b["ry"]) & (y <= b["_y"])
        found.append(F.array_min(F.transform(F.filter(f"_bs{v}", holds), lambda b: b[order])))
    first = (F.least(*found) if len(found) > 1 else found[0]) if found else F.lit(None).cast(regions.schema[order].dataType)
    return got.select(*[runs[c] if not levels else F.col(c) for c in runs.columns], first.alias(order))
