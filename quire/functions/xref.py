"""Fixed-width and bit-packed tables in bytes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsigned(data: Column, at: Column, width: Column) -> Column:
    """The big-endian number in ``width`` bytes from offset ``at``; null beyond 63 bits or the data's end, and 0 for no bytes."""
    part = F.substring(data, at + 1, width)
    number = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    return F.when(width == 0, F.lit(0).cast("long")).when((at >= 0) & (F.octet_length(part) == width) & (width <= 8) & (number <= (1 << 63) - 1), number.cast("long"))


def bits(data: Column, at: Column, width: Column) -> Column:
    """The number in ``width`` bits (56 at most) from bit ``at``, the highest bit first; null beyond the data's end, and 0 for no bits."""
    at, width = at.cast("long"), width.cast("long")
    first, end = F.floor(at / 8), F.ceil((at + width) / 8)
    part = unsigned(data, first.cast("int"), (end - first).cast("int"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int")) - 1
    behind = (end * 8 - at - width).cast("int")
    return F.when(width == 0, F.lit(0).cast("long")).when(width <= 56, F.call_function("shiftright", part, behind).bitwiseAND(mask))


def stream_rows(rows: DataFrame, keys: list[str], content: str, widths: str, index: str) -> DataFrame:
    """(keys, num, place, at, third) from cross-reference streams: decoded bytes, three field widths, and pairs (first number, count).

    An entry's type is 1 where the first width is 0; free entries (0) go; type 1 is "at" an
    offset with a generation, any other "in" an object stream with an index. Entries that the
    data doesn't hold to their end go, and so do rows with a null, or with other than three widths.
    """
    w, pairs = F.col(widths), F.col(index)
    # the entries before each pair, then a row for each of its numbers
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / 2).cast("int") - 1), lambda k: F.struct(F.get(pairs, 2 * k).cast("long").alias("first"), F.greatest(F.get(pairs, 2 * k + 1), F.lit(0)).cast("long").alias("n"), F.aggregate(F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i < k, F.greatest(F.get(pairs, 2 * i + 1), F.lit(0))).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("before")))
    good = rows.where(F.col(content).isNotNull() & (F.size(w) == 3) & (F.size(pairs) >= 2))
    entries = good.select(*keys, F.col(content).alias("_data"), w.alias("_w"), F.explode(runs).alias("_r")).where("_r.n > 0")
    wide = F.aggregate("_w", F.lit(0).cast("long"), lambda a, b: a + b).cast("int")
    # no more numbers than the data has entries, whatever the pair says
    held = F.least(F.col("_r.n"), F.floor(F.octet_length("_data") / wide) - F.col("_r.before"))
    entries = entries.where((wide > 0) & (held > 0)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), held - 1)))
    base = ((F.col("_r.before") + F.col("_i")) * wide).cast("int")
    w0, w1, w2 = (F.col("_w")[k].cast("int") for k in range(3))
    kind = F.when(w0 == 0, F.lit(1).cast("long")).otherwise(unsigned(F.col("_data"), base, w0))
    out = entries.select(*keys, (F.col("_r.first") + F.col("_i")).alias("num"), kind.alias("_kind"), unsigned(F.col("_data"), base + w0, w1).alias("at"), unsigned(F.col("_data"), base + w0 + w1, w2).alias("third"))
    return out.where("_kind <> 0").select(*keys, "num", F.when(F.col("_kind") == 1, "at").otherwise("in").alias("place"), "at", "third")


#: The fields in the head of a page hint table: name and bytes (fixed values).
HINTS = (("least_objects", 4), ("first_at", 4), ("objects_bits", 2), ("least_length", 4), ("length_bits", 2), ("least_content_at", 4), ("content_at_bits", 2), ("least_content", 4), ("content_bits", 2), ("shared_bits", 2), ("identifier_bits", 2), ("numerator_bits", 2), ("denominator", 2))


def page_hints(rows: DataFrame, keys: list[str], content: str, pages: str) -> DataFrame:
    """(keys, page_idx, objects, length) from page hint tables: how many objects a page has and how many bytes it takes.

    Behind the head stand the pages' differences to the least number of objects, packed in
    as many bits as the head says, and from the next whole byte on those to the least
    length. A table that ends before a page's entries has no row for it.
    """
    data, at, head = F.col("_data"), 0, {}
    for name, n in HINTS:
        head[name] = unsigned(data, F.lit(at), F.lit(n))
        at += n
    got = rows.select(*keys, F.col(content).alias("_data"), F.col(pages).cast("int").alias("_n")).where("_data IS NOT NULL AND _n > 0")
    got = got.select("*", *[head[k].alias(f"_{k}") for k in ("least_objects", "objects_bits", "least_length", "length_bits")]).withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.lit(8 * at).cast("long")
    second = start + F.floor((F.col("_n") * F.col("_objects_bits") + 7) / 8) * 8
    objects = bits(F.col("_data"), start + F.col("page_idx") * F.col("_objects_bits"), F.col("_objects_bits"))
    length = bits(F.col("_data"), second + F.col("page_idx") * F.col("_length_bits"), F.col("_length_bits"))
    out = got.select(*keys, "page_idx", (F.col("_least_objects") + objects).alias("objects"), (F.col("_least_length") + length).alias("length"))
    return out.where("objects IS NOT NULL AND length IS NOT NULL")
