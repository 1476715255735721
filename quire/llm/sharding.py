"""Operator 10, sharding: proportional stratified interleaving, all in the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table

#: Rows that one task ranks; the number of hash buckets follows from it.
ROWS_PER_BUCKET = 20_000


def interleave(df: DataFrame, id_col: str, stratum_col: str, shards: int, seed: int = 0, ties: list[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``shard`` (0-based int) and ``slot`` (long, gapless from 0 in a shard).

    Rows are shuffled within each stratum by a seeded hash of their id and ranked;
    a row's fractional rank is (rank - 1/2) / (rows of its stratum). Ordered by that,
    every stratum is spread evenly over the whole, so equal cuts of the order hold
    each stratum in proportion. Shards differ by one row at most.

    No rank is taken over a whole stratum: the hash cuts it into buckets of about
    ``rows_per_bucket`` rows, ranks are local to a bucket, and running totals over the
    (small) table of bucket counts make them global. A stratum with a third of all
    rows is thus ranked by as many tasks as its size asks for. The second order is
    cut in the same way by the fractional rank itself.

    A null stratum is a stratum; a null id is hashed as such. Rows that agree in id
    and in ``ties`` are interchangeable. An empty input gives an empty result.
    Clashing column names: those that this adds replace the input's.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    total = df.count()
    if not total:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)
    buckets = max(1, -(-total // rows_per_bucket))
    carried = [c for c in df.columns]
    key: Column = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = df.select(F.struct(*[df[c] for c in carried]).alias("_row"), key.alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("_stratum"))
    rows = rows.withColumn("_b", F.shiftright(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * buckets, 28))
    order = [F.col("_key"), *[F.col(f"_row.{c}") for c in [id_col, *ties]]]

    counts = rows.groupBy("_stratum", "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_stratum")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_stratum", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_of"))
    local = F.row_number().over(Window.partitionBy("_stratum", "_b").orderBy(*order))
    ranked = rows.withColumn("_r", local).join(counts, ["_stratum", "_b"])
    ranked = ranked.withColumn("_frac", (F.lit(2.0) * (F.col("_base") + F.col("_r")) - 1) / (F.lit(2.0) * F.col("_of")))
    ranked = ranked.select("_row", "_key", "_frac", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)).alias("_f"))

    cuts = ranked.groupBy("_f").agg(F.count("*").alias("_n"))
    cuts = cuts.select("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_f").orderBy("_frac", *order))
    placed = ranked.withColumn("_r", local).join(cuts, "_f").withColumn("_pos", F.col("_base") + F.col("_r") - 1)
    placed = placed.withColumn("shard", F.expr(f"CAST((_pos * {shards}) DIV {total} AS INT)"))
    return placed.select("_row.*", "shard", F.expr(f"_pos - (shard * {total}L + {shards - 1}) DIV {shards}").alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(light, "doc_id", "source", 24, ties=["size", "text_crc32"])
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte, with the table made from its polynomial; then the order as in ``interleave``.
OP10_SQL = """
WITH RECURSIVE poly(b, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8
),
crc AS (SELECT list(v ORDER BY b) AS t FROM poly WHERE k = 8),
hexed AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, source, CAST(bytes + 8 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(bytes), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
             lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc
),
ranked AS (
  SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
         row_number() OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size, text_crc32) AS r,
         count(*) OVER (PARTITION BY source) AS n
  FROM summed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2.0::DOUBLE * r - 1) / (2.0::DOUBLE * n), k, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(pos * 24 // total AS INT) AS shard,
       CAST(pos - ((pos * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""
