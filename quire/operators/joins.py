"""Lookups of a document toolkit as joins: as-of, ranges, latest version, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the right row of its key with the greatest start <= at.

    One pass: both sides are ordered together within a key and the last right row seen is
    carried on. The work is a shuffle and a sort; no row meets more than one other.
    """
    row, last = F.struct(*left.columns), F.struct(*take)
    row_type, last_type = left.select(row.alias("s")).schema["s"].dataType, right.select(last.alias("s")).schema["s"].dataType
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(last_type).alias("_take"))
    b = right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"), last.alias("_take"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_side = 1")
    return got.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def range_lookup(codes: DataFrame, code: str, ranges: DataFrame, missing: int = -1) -> DataFrame:
    """``cid`` = base + code - lo of the range that holds the code, else ``missing``.

    Ranges (lo, hi, base) are wide: they are cut into cells of equal width so that the
    lookup is a join on the cell, not a comparison of all codes with all ranges.
    """
    cell = 1 << 10
    cut = ranges.withColumn("_c", F.explode(F.sequence(F.expr(f"lo DIV {cell}"), F.expr(f"hi DIV {cell}"))))
    hit = codes.withColumn("_c", F.expr(f"{code} DIV {cell}")).join(cut, ["_c"], "left").where(f"lo IS NULL OR {code} BETWEEN lo AND hi")
    found = hit.where("lo IS NOT NULL").select(code, F.expr(f"base + {code} - lo").alias("_cid")).groupBy(code).agg(F.min("_cid").alias("_cid"))
    return codes.join(found, code, "left").withColumn("cid", F.coalesce("_cid", F.lit(missing)).cast("bigint")).drop("_cid")


def coalesce_ranges(ranges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Neighbouring ranges whose codes and targets both go on become one."""
    w = Window.partitionBy(*keys).orderBy("lo")
    new = ~((F.lag("hi").over(w) + 1 == F.col("lo")) & (F.lag(F.col("base") + F.col("hi") - F.col("lo")).over(w) + 1 == F.col("base")))
    marked = ranges.withColumn("_n", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(*keys, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("base").alias("base")).drop("_n")


def in_codespace(code: Column, lo: bytes, hi: bytes) -> Column:
    """Whether each byte of the code lies between those of the bounds; the length must agree."""
    h = F.hex(code)
    ok = F.octet_length(code) == len(lo)
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        ok = ok & F.substring(h, 2 * i + 1, 2).between(f"{a:02X}", f"{b:02X}")
    return ok


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given order; ties by none, so the order should be whole.

    An aggregate with partial results, not a ranking: a key with very many rows is cut
    down in each task before it is shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
