"""Queries that put things and the runs of a page together: graphics state, links, search hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import structure as S
from quire.functions import unicode_text
from quire.operators import graphics, highlight, layout, lines, links, tokens
from quire.plans.pdfs import made
from quire.session import table
from quire.sources import pdf
from quire.sources.runs import RUNS_SQL, runs

#: What a word becomes as an operator, by its length and place modulo 10; ``n`` is its place modulo 5.
OPERATORS = ("q", "Q", "rg", "g", "w", "RG", "sc", "cs", "Tj", "TJ")
#: Words that the search looks for.
WORDS = ("the", "of the", "er d")


def page_operators(spark, sf):
    """(doc_id, page_idx, seq, op, operands): an operator for each word of a page; about a fifth of them save or restore."""
    n = (F.col("word_idx") % 5).cast("string")
    shown = F.concat(F.lit("<"), F.hex(F.encode("text", "UTF-8")), F.lit(">"))
    operands = F.array(F.lit(""), F.lit(""), F.concat(n, F.lit(" 0 1")), F.concat(F.lit("0."), n), n, F.concat(F.lit("0 1 "), n), F.concat(F.lit("1 "), n, F.lit(" 0")), F.lit("/DeviceCMYK"), shown, F.concat(F.lit("["), shown, F.lit(" -2 (5 w)]")))
    k = ((F.length("text") + F.col("word_idx")) % 10 + 1).cast("int")
    seq = (F.col("line_idx").cast("long") * 1_000_000 + F.col("word_idx")).alias("seq")
    return runs(spark, sf).select("doc_id", "page_idx", seq, F.element_at(F.array(*map(F.lit, OPERATORS)), k).alias("op"), F.element_at(operands, k).alias("operands"))


def _spelled(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


def operator_state(spark, sf):
    """Text colours, L14: colours and line width in effect at each operator that shows text."""
    got = graphics.state_at(page_operators(spark, sf), ["doc_id", "page_idx"], F.col("op").isin(*graphics.SHOWS), ["fill_space", "fill", "stroke_space", "stroke", "line_width"])
    return got.select("doc_id", "page_idx", "seq", "op", "level", "fill_space", _spelled("fill"), "stroke_space", _spelled("stroke"), "line_width")


def stream_operators(spark, sf):
    """The same operators written as a page's content stream, and cut out of its bytes again."""
    ops = page_operators(spark, sf).select("doc_id", "page_idx", "seq", F.concat_ws(" ", F.when(F.col("operands") != "", F.col("operands")), "op").alias("t"))
    pages = ops.groupBy("doc_id", "page_idx").agg(F.expr("encode(listagg(t, '\n') WITHIN GROUP (ORDER BY seq), 'ISO-8859-1')").alias("content"))
    return tokens.operators(pages, ["doc_id", "page_idx"], "content")


def pdf_text_colours(spark, sf):
    """The same from the operators of files: what shows or paints, by its state."""
    keys = ["doc_id", "page_idx"]
    used = ["fill_space", "fill", "stroke", "font", "font_size", "mode", "line_width"]
    got = graphics.state_at(pdf.stretches(made(spark, sf), "doc_id"), keys, F.col("op").isin(*graphics.SHOWS, "f", "s"), used)
    return got.groupBy(*keys, "op", "level", "fill_space", _spelled("fill"), _spelled("stroke"), "font", "font_size", "mode", "line_width").agg(F.sum("n").alias("n"))


def link_texts(spark, sf):
    """URLs with the text of their area: on every third line a link over its second to fourth word and what stands above."""
    base = runs(spark, sf)
    here = base.where("line_idx % 3 = 1 AND word_idx BETWEEN 1 AND 3").groupBy("doc_id", "page_idx", F.col("line_idx").alias("ord"))
    areas = here.agg(F.min("x").alias("x0"), (F.min("y") - 1).alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), (F.min("y") + 15).alias("y1"))
    areas = areas.withColumn("uri", F.concat(F.lit("http://x.org/"), "doc_id", F.lit("/"), "ord"))
    pages = areas.select("doc_id", "page_idx").distinct().select("*", F.lit(842).alias("height"), F.lit(0).alias("rotate"))
    seq = (F.col("line_idx").cast("long") * 1_000_000 + F.col("word_idx")).alias("seq")
    got = links.url_texts(areas, base.select("doc_id", "page_idx", seq, "x", "y", "text"), pages, ["doc_id", "page_idx"])
    return got.select("doc_id", "page_idx", "ord", "uri", "runs", "text")


def search_highlights(spark, sf):
    """Each search hit in a page's text with its runs and the box around them."""
    base = runs(spark, sf)
    w = Window.partitionBy("doc_id", "page_idx").orderBy("line_idx", "word_idx")
    base = base.withColumn("sep", F.when(F.lead("line_idx").over(w) == F.col("line_idx"), " ").otherwise("\n"))
    return highlight.highlights(base, ["doc_id", "page_idx"], ["line_idx", "word_idx"], list(WORDS), F.col("sep"))


def line_words(spark, sf):
    """Words of a line of glyphs, of which spaces end one."""
    items = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split(F.concat(F.lit(" "), "p_name", F.when(F.col("p_size") % 2 == 0, "  ").otherwise("")), "")).alias("k", "c"))
    return lines.normalised(items, ["p_partkey"], "k", F.col("c"), F.col("c") == " ")


def _italic():
    return (F.length("text") + F.col("word_idx")) % 3 == 0


def nested_emphasis(spark, sf):
    """Bold and italic, one inside the other, as marks before runs and behind a page's last one."""
    got = lines.nested_emphasis(runs(spark, sf), ["doc_id", "page_idx"], ["line_idx", "word_idx"], F.col("bold"), _italic())
    return got.where("mark <> '' OR close <> ''").select("doc_id", "page_idx", "line_idx", "word_idx", "mark", "close")


def marked_overlaps(spark, sf):
    """Copies at less than a third of a character go, those at just that distance stay."""
    base = runs(spark, sf).withColumn("seq", F.col("line_idx").cast("long") * (1 << 32) + F.col("word_idx"))
    both = base.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumns({"x": F.col("x") + F.col("copy") * (F.col("word_idx") % 3), "seq": F.col("seq") + F.col("copy") * F.lit(1 << 60)})
    both = both.select("doc_id", "page_idx", "line_idx", "word_idx", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "font_size")], "seq")
    return layout.suppress_overlaps(both, strict=True).select("doc_id", "page_idx", "line_idx", "word_idx", "x")


def text_separators(spark, sf):
    """A document's text with all marks, two articles a page and a paragraph every fourth line."""
    r = runs(spark, sf).select("doc_id", F.col("page_idx").alias("page"), (F.col("line_idx") % 20 >= 10).cast("int").alias("article"), F.col("line_idx").alias("line"), F.col("word_idx").alias("word"), "text", (F.col("line_idx") % 4 == 0).alias("paragraph"))
    return layout.document_text(r, ["doc_id"], page_start="<S>", page_end="<E>", article_start="[", article_end="]", paragraph_start="{", paragraph_end="}", line="/")


#: A word from right to left (fixed value of the demonstration).
WORD = "\u05e9\u05dc\u05d5\u05dd"


def unicode_texts(spark, sf):
    """Presentation forms, lines in both base directions, prepared names."""
    p = table(spark, sf, "part")
    over = lambda name, *parts: unicode_text.over_text(name, F.concat(*[x if isinstance(x, str) and x.startswith("p_") else F.lit(x) for x in parts]))
    return p.select(
        "p_partkey", over("presentation", "\ufb01\ufb02 ", "p_name").alias("forms"), over("logical", "p_brand", " " + WORD[::-1]).alias("left_to_right"),
        over("logical", WORD[::-1] + " ", "p_brand").alias("right_to_left"), over("prepared", "p_name", "\u00a0\u00adx").alias("prepared"),
    )


def fdf_roundtrip(spark, sf):
    """K9: fields with qualified names written as form data and read back."""
    c = table(spark, sf, "customer")
    held = c.select("c_nationkey", F.concat(F.lit("form."), "c_mktsegment", F.lit("."), "c_custkey").alias("name"), F.concat(F.lit("(\u00e9\\) "), "c_name").alias("value"))
    files = S.fdf(held, ["c_nationkey"], "name", "value").withColumnRenamed("fdf", "content")
    return S.form_data(files, "c_nationkey", False)


QUERIES = {f.__name__: f for f in (stream_operators, text_separators, line_words, nested_emphasis, marked_overlaps, unicode_texts, fdf_roundtrip, operator_state, pdf_text_colours, link_texts, search_highlights)}

_STATE = {
    "fill_space": ("2, 3, 7", "CASE c WHEN 2 THEN 'DeviceRGB' WHEN 3 THEN 'DeviceGray' ELSE 'DeviceCMYK' END", "DeviceGray"),
    "fill": ("2, 3, 6, 7", "CASE c WHEN 2 THEN n || '.0 0.0 1.0' WHEN 3 THEN '0.' || n WHEN 6 THEN '1.0 ' || n || '.0 0.0' ELSE '0.0 0.0 0.0 0.0' END", "0.0"),
    "stroke_space": ("5", "'DeviceRGB'", "DeviceGray"),
    "stroke": ("5", "'0.0 1.0 ' || n || '.0'", "0.0"),
    "line_width": ("4", "CAST(n AS VARCHAR)", "1"),
}
_SETTERS = " UNION ALL ".join(f"SELECT doc_id, page_idx, seq, depth, '{p}' AS p, {v} AS v FROM levels WHERE c IN ({c})" for p, (c, v, _) in _STATE.items())
_TOPS = ", ".join(f"coalesce(arg_max(v, s.seq) FILTER (p = '{p}'), '{d}') AS {p}" for p, (_, _, d) in _STATE.items())
_HITS = " UNION ALL ".join(f"SELECT doc_id, page_idx, '{w}' AS word, string_split_regex(text, '(?i){w}') AS p, regexp_extract_all(text, '(?i){w}') AS m FROM pages" for w in WORDS)
_SHOWN = "hex(encode(text))"
SQL = {
    "stream_operators": f"""WITH {RUNS_SQL},
o AS (SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx, word_idx) - 1 AS INT) AS seq, (length(text) + word_idx) % 10 AS c, word_idx % 5 AS n, text FROM runs)
SELECT doc_id, page_idx, seq, {list(OPERATORS)}[c + 1] AS op, CASE c WHEN 2 THEN n || ' 0 1' WHEN 3 THEN '0.' || n WHEN 4 THEN CAST(n AS VARCHAR) WHEN 5 THEN '0 1 ' || n WHEN 6 THEN '1 ' || n || ' 0' WHEN 7 THEN '/DeviceCMYK'
  WHEN 8 THEN '<' || {_SHOWN} || '>' WHEN 9 THEN '[ <' || {_SHOWN} || '> -2 (5 w) ]' ELSE '' END AS operands FROM o""",
    "text_separators": f"""WITH {RUNS_SQL},
l AS (SELECT doc_id, page_idx, line_idx % 20 >= 10 AS a, line_idx, string_agg(text, ' ' ORDER BY word_idx) AS t FROM runs GROUP BY ALL),
o AS (SELECT *, CASE WHEN line_idx = min(line_idx) OVER (PARTITION BY doc_id, page_idx, a) THEN '{{' WHEN line_idx % 4 = 0 THEN '/}}{{' ELSE '/' END || t AS x FROM l),
p AS (SELECT doc_id, page_idx, a, '[' || string_agg(x, '' ORDER BY line_idx) || '}}]' AS t FROM o GROUP BY ALL),
g AS (SELECT doc_id, page_idx, '<S>' || string_agg(t, '' ORDER BY a) || '<E>' AS t FROM p GROUP BY ALL)
SELECT doc_id, string_agg(t, '' ORDER BY page_idx) AS text FROM g GROUP BY doc_id""",
    "line_words": """
WITH w AS (SELECT p_partkey, string_split(' ' || p_name || CASE WHEN p_size % 2 = 0 THEN '  ' ELSE '' END, ' ') AS ws FROM part WHERE p_name IS NOT NULL),
u AS (SELECT p_partkey, len(ws) AS n, unnest(ws) AS text, unnest(range(len(ws))) AS word FROM w)
SELECT p_partkey, CAST(word AS INT) AS word, text, length(text) AS items FROM u WHERE word < n - 1 OR text <> ''""",
    "nested_emphasis": f"""WITH {RUNS_SQL},
r AS (SELECT *, (length(text) + word_idx) % 3 = 0 AS i, row_number() OVER w AS n, lag(bold) OVER w AS pb, lead(n) OVER w IS NULL AS last FROM (SELECT *, 1 AS n FROM runs) WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_idx, word_idx)),
q AS (SELECT doc_id, page_idx, line_idx, word_idx, bold AS b, i, last, n, coalesce(pb, false) AS pb, coalesce(lag(i) OVER w, false) AS pi FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx, word_idx) AS n FROM r) WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY n)),
s AS (SELECT *, max(CASE WHEN b AND NOT pb THEN n END) OVER w AS sb, max(CASE WHEN i AND NOT pi THEN n END) OVER w AS si FROM q WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY n)),
t AS (SELECT *, lag(sb) OVER w AS lb, lag(si) OVER w AS li FROM s WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY n)),
m AS (SELECT doc_id, page_idx, line_idx, word_idx,
  CASE WHEN b AND NOT pb THEN '**' WHEN pb AND NOT b THEN CASE WHEN pi AND lb <= li THEN '****' ELSE '**' END ELSE '' END AS x,
  CASE WHEN i AND NOT pi THEN '*' WHEN pi AND NOT i THEN CASE WHEN b AND (NOT pb OR li < lb) THEN '*****' ELSE '*' END ELSE '' END AS y,
  CASE WHEN NOT last THEN '' WHEN b AND i THEN '***' WHEN b THEN '**' WHEN i THEN '*' ELSE '' END AS close FROM t)
SELECT doc_id, page_idx, line_idx, word_idx, x || y AS mark, close FROM m WHERE x || y <> '' OR close <> ''""",
    "marked_overlaps": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, line_idx, word_idx, CAST(x AS DOUBLE) AS x FROM runs UNION ALL SELECT doc_id, page_idx, line_idx, word_idx, CAST(x + 2 AS DOUBLE) FROM runs WHERE word_idx % 3 = 2",
    "unicode_texts": f"SELECT p_partkey, 'fifl ' || p_name AS forms, p_brand || ' {WORD}' AS left_to_right, p_brand || ' {WORD}' AS right_to_left, p_name || ' x' AS prepared FROM part",
    "fdf_roundtrip": "SELECT c_nationkey, 'form.' || c_mktsegment || '.' || c_custkey AS name, '(\u00e9\\) ' || c_name AS value FROM customer",
    # a setter holds until the first restore that goes below its level
    "operator_state": f"""WITH {RUNS_SQL},
ops AS (SELECT doc_id, page_idx, CAST(line_idx AS BIGINT) * 1000000 + word_idx AS seq, (length(text) + word_idx) % 10 AS c, word_idx % 5 AS n FROM runs),
sums AS (SELECT *, sum(CASE c WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY seq) AS s FROM ops),
levels AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY doc_id, page_idx ORDER BY seq)) AS INT) AS depth FROM sums),
setters AS ({_SETTERS}),
until AS (SELECT s.doc_id, s.page_idx, s.seq, s.p, s.v, min(q.seq) AS stop FROM setters s LEFT JOIN levels q ON q.doc_id = s.doc_id AND q.page_idx = s.page_idx AND q.c = 1 AND q.seq > s.seq AND q.depth < s.depth GROUP BY ALL),
got AS (SELECT t.doc_id, t.page_idx, t.seq, t.c, t.depth, {_TOPS} FROM levels t LEFT JOIN until s ON s.doc_id = t.doc_id AND s.page_idx = t.page_idx AND s.seq < t.seq AND (s.stop IS NULL OR s.stop > t.seq) WHERE t.c >= 8 GROUP BY ALL)
SELECT doc_id, page_idx, seq, CASE c WHEN 8 THEN 'Tj' ELSE 'TJ' END AS op, depth AS level, fill_space, fill, stroke_space, stroke, CAST(line_width AS DOUBLE) AS line_width FROM got""",
    "pdf_text_colours": f"""WITH {RUNS_SQL}, p AS (SELECT DISTINCT doc_id, page_idx FROM lines)
SELECT doc_id, page_idx, 'TJ' AS op, 0 AS level, 'DeviceGray' AS fill_space, '0.0' AS fill, '0.0' AS stroke, 'F1' AS font, 12.0::DOUBLE AS font_size, 0 AS mode, 1.0::DOUBLE AS line_width, count(*) AS n FROM runs GROUP BY ALL
UNION ALL SELECT doc_id, page_idx, unnest(['f', 's']), 1, 'DeviceRGB', (page_idx % 2) || '.0 0.0 1.0', '0.0', '', 0, 0, 1, 1 FROM p""",
    "link_texts": f"""WITH {RUNS_SQL},
a AS (SELECT doc_id, page_idx, line_idx AS ord, min(x) AS x0, min(y) - 1 AS y0, max(x + width) AS x1, min(y) + 15 AS y1 FROM runs WHERE line_idx % 3 = 1 AND word_idx BETWEEN 1 AND 3 GROUP BY ALL),
l AS (SELECT a.doc_id, a.page_idx, ord, y, count(*) AS n, string_agg(text, ' ' ORDER BY x, word_idx) AS line FROM a JOIN runs r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL)
SELECT doc_id, page_idx, ord, 'http://x.org/' || doc_id || '/' || ord AS uri, CAST(sum(n) AS BIGINT) AS runs, string_agg(line, chr(10) ORDER BY y DESC) AS text FROM l GROUP BY ALL""",
    "search_highlights": f"""WITH {RUNS_SQL},
parts AS (SELECT *, CASE WHEN lead(line_idx) OVER w = line_idx THEN ' ' ELSE chr(10) END AS sep, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM runs WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_idx, word_idx)),
pages AS (SELECT doc_id, page_idx, string_agg(text || sep, '' ORDER BY start) AS text FROM parts GROUP BY ALL),
cut AS ({_HITS}),
pieces AS (SELECT doc_id, page_idx, word, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(p[1:len(m)]) AS p FROM cut WHERE len(m) > 0),
hits AS (SELECT doc_id, page_idx, word, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, page_idx, word ORDER BY i) - length(m) AS BIGINT) AS pos, CAST(length(m) AS INT) AS len FROM pieces)
SELECT h.doc_id, h.page_idx, word, pos, len, count(text) AS runs, CAST(min(start) AS BIGINT) AS "from", CAST(max(start + length(text)) AS BIGINT) AS "to", min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + font_size) AS y1
FROM hits h LEFT JOIN parts r ON r.doc_id = h.doc_id AND r.page_idx = h.page_idx AND start < pos + len AND start + length(text) > pos GROUP BY h.doc_id, h.page_idx, word, pos, len""",
}
