"""Positioned text runs derived from plain documents, in place of parsed pages.

A line is a row of a page with 20 rows; a word is a run whose geometry follows from its
place: all numbers are whole, so any engine computes the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import size_of, table

ROWS = 20
#: Bytes of a table's file whose texts a task takes: its runs are some thirty times larger in memory, where they are sorted.
DEALT = 4 << 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_idx, page_idx, page_no, line): one row a line."""
    return _paged(table(spark, sf_dir, "documents").select("doc_id", "text"))


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with the rows of a document in one partition.

    The texts are dealt by document before they are cut, so that groups and windows over
    a document, its pages or its lines need no exchange of their own: one shuffle of the
    texts in place of one or more of the much larger runs. There are so many partitions
    that a sort of one's runs fits into a task's memory.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    splits = docs.rdd.getNumPartitions()
    most = -(-size_of(spark.conf.get("spark.sql.files.maxPartitionBytes")) // DEALT) if splits > 1 else 1
    parts = max(splits * most, spark.sparkContext.defaultParallelism)  # a number, so that small texts aren't put into one task
    return _paged(docs.repartition(parts, "doc_id"))


def _paged(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))
    return rows.withColumn("page_idx", F.expr(f"CAST(line_idx DIV {ROWS} AS INT)")).withColumn("page_no", F.col("page_idx") + 1)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the runs' words alone, without geometry and without a shuffle."""
    rows = lines(spark, sf_dir).select("doc_id", F.explode(F.split("line", " ", -1)).alias("text"))
    return rows.where("text <> ''")


def runs(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """One row a word: doc_id, page_idx, line_idx, word_idx, text, x, y, width, font_size, bold.

    A word's offset is the place behind the space before it, and the places of all spaces
    come from one pass over the line's characters. ``dealt``: by document, for queries
    that group or order; others need no shuffle.
    """
    rows = by_document(spark, sf_dir) if dealt else lines(spark, sf_dir)
    behind = F.array_compact(F.transform(F.split("line", "", -1), lambda c, i: F.when(c == " ", i + 1)))
    rows = rows.select("doc_id", "page_idx", "line_idx", F.split("line", " ", -1).alias("ws"), F.concat(F.array(F.lit(0)), behind).alias("at"))
    rows = rows.select("doc_id", "page_idx", "line_idx", F.posexplode(F.arrays_zip(F.col("ws").alias("t"), F.col("at").alias("o"))).alias("word_idx", "w")).where("w.t <> ''")
    return rows.select(
        "doc_id", "page_idx", "line_idx", "word_idx", F.col("w.t").alias("text"), (72 + 6 * F.col("w.o")).alias("x"), (800 - 14 * (F.col("line_idx") % ROWS)).alias("y"),
        (6 * F.length("w.t")).alias("width"), F.lit(12).alias("font_size"), (F.col("w.t") == F.upper("w.t")).alias("bold"),
    )


#: The same two tables as DuckDB common table expressions.
LINES_SQL = f"""
lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_idx, CAST((i - 1) // {ROWS} AS INT) AS page_idx, CAST((i - 1) // {ROWS} + 1 AS INT) AS page_no, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""
RUNS_SQL = (
    LINES_SQL
    + f""",
words AS (
  SELECT doc_id, page_idx, line_idx, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS k FROM lines
),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM words),
runs AS (
  SELECT doc_id, page_idx, line_idx, CAST(k AS INT) AS word_idx, text, CAST(72 + 6 * o AS INT) AS x,
         CAST(800 - 14 * (line_idx % {ROWS}) AS INT) AS y, CAST(6 * length(text) AS INT) AS width, 12 AS font_size, text = upper(text) AS bold
  FROM placed WHERE text <> ''
)"""
)
