"""Running numbers over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about, and the most buckets; beyond that they grow.
ROWS, MOST = 1 << 16, 1024


def bucket(rows: DataFrame, key: str, size: int = ROWS) -> Column:
    """The number of a key's bucket, in the order of the keys: cut by quantiles, so sparse, hashed and dense keys alike fill them evenly.

    Null keys have a bucket of their own before all others. Takes one pass over the keys.
    """
    n = rows.count()
    parts = min(MOST, -(-n // size))
    # whole numbers are compared as such: a double can't tell large ones apart
    cuts = sorted({int(x) for x in rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if not blocks:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    # first the block whose first cut is the last one not above the key, then the cut in it
    firsts = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    lists = F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks])
    block = F.size(F.filter(firsts, lambda c: c <= F.col(key)))
    inside = F.size(F.filter(F.element_at(lists, block), lambda c: c <= F.col(key)))
    return F.when(F.col(key).isNull(), -1).when(block == 0, 0).otherwise((block - 1) * wide + inside)


def numbered(rows: DataFrame, order: list[str], name: str, size: int = ROWS) -> DataFrame:
    """``name``: the row's number from 1 in the given order; the last column is a whole number, and null comes first.

    Rows are ranked inside buckets of the last column, and the rows in the buckets before
    are added. Only the bucket totals, a row each, meet in one task.
    """
    lead, key = order[:-1], order[-1]
    held = rows.withColumn("_b", bucket(rows, key, size))
    totals = held.groupBy(*lead, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*lead, "_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*lead, "_b"]]
    inside = F.row_number().over(Window.partitionBy(*lead, "_b").orderBy(key))
    ranked = held.withColumn("_k", inside)
    got = ranked.alias("l").join(totals.alias("r"), on, "left")
    return got.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("r._before") + F.col("l._k")).alias(name))


def running(rows: DataFrame, key: str, value: str, name: str, size: int = ROWS) -> DataFrame:
    """``name``: the sum of ``value`` over the rows whose whole-numbered ``key`` is less; a row a key is expected."""
    held = rows.withColumn("_b", bucket(rows, key, size))
    sums = held.groupBy("_b").agg(F.sum(value).alias("_v"))
    sums = sums.withColumn("_lower", F.coalesce(F.sum("_v").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_v")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_i", inside).join(sums, "_b").withColumn(name, F.col("_i") + F.col("_lower")).drop("_b", "_i", "_lower")
