"""Queries over lines and positioned runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import layout, spatial
from quire.session import table
from quire.sources.runs import LINES_SQL, RUNS_SQL, by_document, lines, runs, words

#: Regions of a page (fixed values of the demonstration): name, x, y, width, height.
REGIONS = (("head", 72, 786, 300, 28), ("left", 72, 520, 120, 250), ("overlap", 150, 700, 200, 100))
RUN = ["doc_id", "page_idx", "line_idx", "word_idx"]


def _regions(spark):
    return spark.createDataFrame(list(REGIONS), "region string, rx int, ry int, rw int, rh int")


def page_range_filter(spark, sf):
    return lines(spark, sf).where(F.col("page_no").between(2, 3)).select("doc_id", "page_no", "line_idx", "line")


def page_extract_span(spark, sf):
    return lines(spark, sf).where("page_no BETWEEN 1 AND 2").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.countDistinct("page_no").alias("n_pages"))


def page_text(spark, sf):
    return layout.page_text(runs(spark, sf))


def doc_text_separators(spark, sf):
    return layout.page_text(runs(spark, sf)).groupBy("doc_id").agg(F.expr("listagg(text, '\n\f\n') WITHIN GROUP (ORDER BY page_idx)").alias("text"))


def reading_order(spark, sf):
    return layout.reading_order(runs(spark, sf)).select(*RUN, "ord")


def line_grouping(spark, sf):
    return layout.line_numbers(runs(spark, sf)).groupBy("doc_id", "page_idx", "line_no").agg(F.count("*").alias("n"), F.max("y").alias("y"))


def word_breaks(spark, sf):
    return layout.word_breaks(runs(spark, sf), 0.4).groupBy("doc_id", "page_idx").agg(F.count_if("word_break").alias("breaks"), F.count("*").alias("runs"))


def paragraph_drop(spark, sf):
    got = layout.paragraph_marks(layout.line_starts(runs(spark, sf)), drop=1.5)
    return got.select("doc_id", "page_idx", "line_idx", "dropped", "indented")


def text_by_region(spark, sf):
    held = spatial.in_regions(runs(spark, sf), F.broadcast(_regions(spark)))  # three literal rows
    return held.groupBy("doc_id", "page_idx", "region").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY line_idx, word_idx)").alias("text"))


def emphasis_transitions(spark, sf):
    return layout.emphasis(runs(spark, sf)).where("mark <> ''").groupBy("doc_id", "page_idx").agg(F.count("*").alias("marks"))


def dup_overlap_suppress(spark, sf):
    base = runs(spark, sf).withColumn("seq", F.col("line_idx").cast("long") * (1 << 32) + F.col("word_idx"))
    both = base.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))  # behind every original
    both = both.withColumns({"x": F.col("x") + F.col("copy"), "seq": F.col("seq") + F.col("copy") * F.lit(1 << 60)})
    both = both.select(*RUN, "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "font_size")], "seq")
    return layout.suppress_overlaps(both).select(*RUN, "text", "x", "y")


def fonts_used(spark, sf):
    return runs(spark, sf).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("bold"), "bold").otherwise("regular"))), ",").alias("fonts"))


def _postings(spark, sf):
    return words(spark, sf).select(F.lower("text").alias("term"), "doc_id").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def inverted_index(spark, sf):
    return _postings(spark, sf)


def highlight_hits(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?i)the"), F.lit(0))).alias("hits"), F.instr(F.lower("text"), "the").alias("first")).where("hits > 0")


def text_metrics(spark, sf):
    return runs(spark, sf).groupBy("doc_id").agg(F.sum("width").cast("bigint").alias("width"), F.round(F.sum(F.col("font_size") * 0.7), 3).alias("ascent"), F.round(F.sum(F.col("font_size") * -0.2), 3).alias("descent"))


def crop_translation(spark, sf):
    return runs(spark, sf, dealt=False).select(*RUN, (F.col("x") - 36).alias("x"), (F.col("y") - 18).alias("y"))


def booklet_halves(spark, sf):
    side = F.when(F.col("x") < 306, "left").otherwise("right")
    return runs(spark, sf).groupBy("doc_id", "page_idx", side.alias("half")).agg(F.count("*").alias("n"))


def page_labels(spark, sf):
    pages = lines(spark, sf).select("doc_id", "page_idx").distinct()
    starts = spark.createDataFrame([(0, "r", None, 1), (1, "D", "p-", 1), (3, "A", "", 26)], "start_idx int, style string, prefix string, first int")
    from quire.operators.joins import as_of

    ids = pages.select("doc_id").distinct()
    got = as_of(pages, ids.crossJoin(F.broadcast(starts)), ["doc_id"], "page_idx", "start_idx", ["start_idx", "style", "prefix", "first"])  # three literal rows
    return got.select("doc_id", "page_idx", scalars.page_label(F.col("style"), F.col("prefix"), F.col("page_idx") - F.col("start_idx") + F.col("first")).alias("label"))


QUERIES = {f.__name__: f for f in (page_range_filter, page_extract_span, page_text, doc_text_separators, reading_order, line_grouping, word_breaks, paragraph_drop, text_by_region, emphasis_transitions, dup_overlap_suppress, fonts_used, inverted_index, highlight_hits, text_metrics, crop_translation, booklet_halves, page_labels)}

_REGION_ROWS = ", ".join(str(r) for r in REGIONS)
SQL = {
    "page_range_filter": f"WITH {LINES_SQL} SELECT doc_id, page_no, line_idx, line FROM lines WHERE page_no BETWEEN 2 AND 3",
    "page_extract_span": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(DISTINCT page_no) AS n_pages FROM lines WHERE page_no BETWEEN 1 AND 2 GROUP BY doc_id",
    "page_text": f"WITH {RUNS_SQL}, l AS (SELECT doc_id, page_idx, line_idx, string_agg(text, ' ' ORDER BY word_idx) AS line FROM runs GROUP BY ALL) SELECT doc_id, page_idx, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM l GROUP BY ALL",
    "doc_text_separators": f"WITH {RUNS_SQL}, l AS (SELECT doc_id, page_idx, line_idx, string_agg(text, ' ' ORDER BY word_idx) AS line FROM runs GROUP BY ALL), p AS (SELECT doc_id, page_idx, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM l GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page_idx) AS text FROM p GROUP BY doc_id",
    "reading_order": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, line_idx, word_idx, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, x, word_idx) AS ord FROM runs",
    "line_grouping": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, dense_rank() OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC) AS line_no, n, y FROM (SELECT doc_id, page_idx, y, count(*) AS n FROM runs GROUP BY ALL)",
    "word_breaks": f"WITH {RUNS_SQL}, b AS (SELECT doc_id, page_idx, coalesce(x - lag(x + width) OVER (PARTITION BY doc_id, page_idx, line_idx ORDER BY x, word_idx) > 0.4 * font_size, false) AS b FROM runs) SELECT doc_id, page_idx, count(*) FILTER (b) AS breaks, count(*) AS runs FROM b GROUP BY ALL",
    "paragraph_drop": f"WITH {RUNS_SQL}, s AS (SELECT doc_id, page_idx, line_idx, min(x) AS x, max(y) AS y FROM runs GROUP BY ALL) SELECT doc_id, page_idx, line_idx, lag(y) OVER w - y > 1.5 * 12 AS dropped, x - lag(x) OVER w > 6 AS indented FROM s WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_idx)",
    "text_by_region": f"WITH {RUNS_SQL}, r(region, rx, ry, rw, rh) AS (VALUES {_REGION_ROWS}) SELECT doc_id, page_idx, region, string_agg(text, ' ' ORDER BY line_idx, word_idx) AS text FROM runs JOIN r ON x >= rx AND x < rx + rw AND y > ry AND y <= ry + rh GROUP BY ALL",
    "emphasis_transitions": f"WITH {RUNS_SQL}, m AS (SELECT doc_id, page_idx, bold <> coalesce(lag(bold) OVER (PARTITION BY doc_id, page_idx, line_idx ORDER BY word_idx), false) AS m FROM runs) SELECT doc_id, page_idx, count(*) AS marks FROM m WHERE m GROUP BY ALL",
    "dup_overlap_suppress": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, line_idx, word_idx, text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM runs",
    "fonts_used": f"WITH {RUNS_SQL} SELECT doc_id, string_agg(DISTINCT CASE WHEN bold THEN 'bold' ELSE 'regular' END, ',' ORDER BY CASE WHEN bold THEN 'bold' ELSE 'regular' END) AS fonts FROM runs GROUP BY doc_id",
    "inverted_index": f"WITH {RUNS_SQL} SELECT lower(text) AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM runs GROUP BY 1",
    "highlight_hits": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[Tt][Hh][Ee]')) AS INT) AS hits, CAST(instr(lower(text), 'the') AS INT) AS first FROM documents WHERE regexp_matches(text, '[Tt][Hh][Ee]')",
    "text_metrics": f"WITH {RUNS_SQL} SELECT doc_id, CAST(sum(width) AS BIGINT) AS width, round(count(*) * 8.4::DOUBLE, 3) AS ascent, round(count(*) * -2.4::DOUBLE, 3) AS descent FROM runs GROUP BY doc_id",
    "crop_translation": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, line_idx, word_idx, x - 36 AS x, y - 18 AS y FROM runs",
    "booklet_halves": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, CASE WHEN x < 306 THEN 'left' ELSE 'right' END AS half, count(*) AS n FROM runs GROUP BY ALL",
    "page_labels": f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, page_idx FROM lines), r(start_idx, style, prefix, first) AS (VALUES (0, 'r', '', 1), (1, 'D', 'p-', 1), (3, 'A', '', 26)),
n AS (SELECT doc_id, page_idx, style, prefix, page_idx - start_idx + first AS n FROM p ASOF JOIN r ON page_idx >= start_idx)
SELECT doc_id, page_idx, prefix || CASE style WHEN 'D' THEN CAST(n AS VARCHAR) WHEN 'A' THEN repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST((n + 25) // 26 AS INT))
  ELSE ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 AS INT) + 1] END AS label FROM n""",
}
