"""Reconstruction of lines, words, paragraphs and pages from positioned runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = ["doc_id", "page_idx"]
#: Edge of the grid cells that overlaps are looked up in, in points.
CELL = 4.0


def _reading(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "word_idx")


def reading_order(runs: DataFrame) -> DataFrame:
    """``ord`` from 1 in each page: higher lines first, then from left to right."""
    return runs.withColumn("ord", F.row_number().over(_reading(*LINE)))


def line_numbers(runs: DataFrame) -> DataFrame:
    """``line_no`` from 1: a run that is lower than its predecessor by its size or more opens a line."""
    w = _reading(*LINE)
    opens = F.coalesce((F.lag("y").over(w) - F.col("y") >= F.col("font_size")).cast("int"), F.lit(1))
    return runs.withColumn("_o", opens).withColumn("line_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_o")


def word_breaks(runs: DataFrame, factor: float = 1.5) -> DataFrame:
    """``word_break``: the gap to the end of the run before it on its line exceeds factor * size.

    A run without width is taken to be half its size wide for each character.
    """
    w = Window.partitionBy(*LINE, "line_idx").orderBy("x", "word_idx")
    width = F.when(F.col("width") > 0, F.col("width").cast("double")).otherwise(0.5 * F.col("font_size") * F.length("text"))
    end = F.lag(F.col("x") + width).over(w)
    return runs.withColumn("word_break", F.coalesce(F.col("x") - end > factor * F.col("font_size"), F.lit(False)))


def line_starts(runs: DataFrame) -> DataFrame:
    """The first run of each line that has one, with the line's text."""
    return runs.groupBy("doc_id", "page_idx", "line_idx").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("font_size").alias("font_size"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_idx)").alias("line"))


def paragraph_marks(starts: DataFrame, drop: float = 2.5, indent: float = 2.0, space: float = 3.0) -> DataFrame:
    """``dropped`` and ``indented`` against the line before it on the page; null for the first."""
    w = Window.partitionBy(*LINE).orderBy("line_idx")
    return starts.withColumns({"dropped": F.lag("y").over(w) - F.col("y") > drop * F.col("font_size"), "indented": F.col("x") - F.lag("x").over(w) > indent * space})


def page_text(runs: DataFrame) -> DataFrame:
    """Words joined by a space, lines by a line feed."""
    lines = runs.groupBy("doc_id", "page_idx", "line_idx").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_idx)").alias("line"))
    return lines.groupBy("doc_id", "page_idx").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_idx)").alias("text"))


#: What stands between and around the parts of a text, by default (fixed values).
SEPARATORS = {"word": " ", "line": "\n", "page_start": "", "page_end": "\n", "article_start": "", "article_end": "", "paragraph_start": "", "paragraph_end": ""}


def document_text(runs: DataFrame, doc: list[str], **separators: str) -> DataFrame:
    """(doc, text) with every mark in its place, from runs (doc, page, article, line, word, text, paragraph).

    A page stands between its start and its end, and so do its articles, whose first line
    opens a paragraph. A line whose ``paragraph`` is true opens another one behind a line
    end: the one before is ended, and the new one started. Words, lines, articles and
    pages come by their numbers. A null text is an empty word; a page is there if it has a
    run. ``separators``: those of ``SEPARATORS`` that differ.
    """
    if unknown := set(separators) - set(SEPARATORS):
        raise ValueError(f"no such separators: {', '.join(sorted(unknown))}")
    sep = {k: F.lit(v) for k, v in (SEPARATORS | separators).items()}

    def joined(order: str, between: str = "") -> Column:
        held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
        return F.array_join(F.transform(held, lambda r: r["t"]), between).alias("text")

    text = F.coalesce("text", F.lit(""))
    word = runs.select(*doc, "page", "article", "line", "word", text.alias("text"), F.coalesce("paragraph", F.lit(False)).alias("paragraph"))
    line = word.groupBy(*doc, "page", "article", "line").agg(joined("word", (SEPARATORS | separators)["word"]), F.bool_or("paragraph").alias("paragraph"))
    first = F.col("line") == F.min("line").over(Window.partitionBy(*doc, "page", "article"))
    opens = F.when(first, sep["paragraph_start"]).when(F.col("paragraph"), F.concat(sep["line"], sep["paragraph_end"], sep["paragraph_start"])).otherwise(sep["line"])
    line = line.withColumn("text", F.concat(opens, "text"))
    article = line.groupBy(*doc, "page", "article").agg(joined("line"))
    article = article.withColumn("text", F.concat(sep["article_start"], "text", sep["paragraph_end"], sep["article_end"]))
    page = article.groupBy(*doc, "page").agg(joined("article")).withColumn("text", F.concat(sep["page_start"], "text", sep["page_end"]))
    return page.groupBy(*doc).agg(joined("page"))


def suppress_overlaps(runs: DataFrame, strict: bool = False) -> DataFrame:
    """Drop a run if an earlier kept one with its text is within a third of a character of it.

    ``strict``, as for marked content: the place at that very distance is outside on both
    sides, not on one, and a run without width suppresses nothing.

    Greedy in the order of ``seq``, a document at a time. Runs of a text that a gap of
    twice the largest distance parts, first in y, then in x, don't touch each other. The
    first run of such a bunch stays and those near it go, for all bunches at once; only
    what is left of bunches that reach farther is folded run by run. ``runs`` needs
    doc_id, page_idx, seq, text, x, y, width, font_size, none of them null.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def near(x, y, tol, a, b):
        return (abs(x - a) < tol) & (abs(y - b) < tol) if strict else (x - tol <= a) & (a < x + tol) & (y - tol <= b) & (b < y + tol)

    def bunches(group, value, tol):
        """A number for each run, in the group's order and parted where the value has a gap."""
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        opens = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        most = np.repeat(np.maximum.reduceat(tol[order], opens), np.diff(np.append(opens, len(g))))
        parted = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] - v[:-1] > 2 * most[1:])))
        out = np.empty(len(g), np.int64)
        out[order] = np.cumsum(parted)
        return out

    def folded(n, bunch, x, y, tol) -> list[int]:
        kept: dict[tuple[int, int, int], list[tuple[float, float]]] = {}
        keep = []
        for i, k, u, v, t in zip(*(c.tolist() for c in (n, bunch, x, y, tol)), strict=True):
            cx, cy = int(u // CELL), int(v // CELL)
            reach = int(t // CELL) + 1
            around = (p for i in range(cx - reach, cx + reach + 1) for j in range(cy - reach, cy + reach + 1) for p in kept.get((k, i, j), ()))
            if not any(near(u, v, t, a, b) for a, b in around):
                kept.setdefault((k, cx, cy), []).append((u, v))
                keep.append(i)
        return keep

    def fold(doc: pa.Table) -> pa.Table:
        page, seq, x, y, width, size = (doc.column(c).to_numpy() for c in ("page_idx", "seq", "x", "y", "width", "font_size"))
        text = doc.column("text").combine_chunks().dictionary_encode()
        code, chars = text.indices.to_numpy(), pc.utf8_length(text.dictionary).to_numpy()[text.indices.to_numpy()]
        by_char = width / np.maximum(chars, 1) / 3
        tol = by_char if strict else np.where((width > 0) & (chars > 0), by_char, np.maximum(size, 0.1) * 0.25)
        group = page.astype(np.int64) * len(text.dictionary) + code
        bunch = bunches(bunches(group, y, tol), x, tol)
        order = np.lexsort((seq, bunch))
        opens = np.flatnonzero(np.concatenate(([True], np.diff(bunch[order]) != 0)))
        first = np.repeat(order[opens], np.diff(np.append(opens, len(order))))
        keep = order[opens]
        left = order[(order != first) & ~near(x[order], y[order], tol[order], x[first], y[first])]
        if len(left):
            left = left[np.argsort(seq[left], kind="stable")]
            keep = np.concatenate((keep, np.array(folded(left, bunch[left], x[left], y[left], tol[left]), np.int64)))
        return doc.take(pa.array(np.sort(keep)))

    return runs.groupBy("doc_id").applyInArrow(fold, runs.schema)


def marked_depth(rows: DataFrame, keys: list[str], seq: str, step: Column) -> DataFrame:
    """``depth`` after each row: openings minus closings, where a closing of nothing is ignored."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = rows.withColumn("_s", F.sum(step).over(w))
    return rows.withColumn("depth", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("int")).drop("_s")


def emphasis(runs: DataFrame) -> DataFrame:
    """``mark``: what to write before the run where bold begins or ends on its line."""
    w = Window.partitionBy(*LINE, "line_idx").orderBy("word_idx")
    before = F.coalesce(F.lag("bold").over(w), F.lit(False))
    return runs.withColumn("mark", F.when(F.col("bold") != before, F.lit("**")).otherwise(F.lit("")))
