"""Merging, splitting and comparing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import ranks


def split_every(pages: DataFrame, size: int, start: int = 1, end: int | None = None) -> DataFrame:
    """``chunk`` from 0 for pages start..end; other pages go. Bad bounds raise at once."""
    if size < 1 or start < 1 or (end is not None and end < start):
        raise ValueError("size and start must be positive and end not before start")
    held = pages.where((F.col("page_no") >= start) & (F.lit(True) if end is None else F.col("page_no") <= end))
    return held.withColumn("chunk", F.expr(f"CAST((page_no - {start}) DIV {size} AS INT)"))


def rename_collisions(fields: DataFrame, stem: str = "dummyFieldName") -> DataFrame:
    """``merged_name``: the first field of a name keeps it, later ones get the stem and a running number.

    Needs (source_ord, name), source_ord a whole number. The number runs over the renamed
    fields only, in the order of their source and, inside it, of their name.
    """
    first = F.row_number().over(Window.partitionBy("name").orderBy("source_ord"))
    rows = fields.withColumn("_k", first)
    again = rows.where("_k > 1")
    again = again.withColumn("_s", F.row_number().over(Window.partitionBy("source_ord").orderBy("name")))
    sizes = ranks.running(again.groupBy("source_ord").agg(F.count("*").alias("_c")), "source_ord", "_c", "_before")
    again = again.join(sizes, "source_ord").withColumn("_n", F.col("_before") + F.col("_s")).drop("_s", "_c", "_before")
    same = rows.where("_k = 1").withColumn("merged_name", F.col("name"))
    return same.drop("_k").unionByName(again.withColumn("merged_name", F.concat(F.lit(stem), F.col("_n").cast("string"))).drop("_k", "_n"))


def unique_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Of rows with the same content, by its SHA-256, the first in the given order."""
    rest = F.struct(*rows.columns)
    return rows.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min_by(rest, order).alias("_r"), F.count("*").alias("copies")).select("_r.*", "sha256", "copies")


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows added, removed or modified between two snapshots, by a hash of the row."""
    rest = sorted(c for c in old.columns if c not in keys)
    a, b = (d.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(h)) for d, h in ((old, "_a"), (new, "_b")))
    both = a.join(b, keys, "full")
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select(*keys, what.alias("change")).where("change IS NOT NULL")
