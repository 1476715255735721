"""Graphics state against the fold, box joins and search hits against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import graphics, highlight, links, spatial
from quire.sources import content

SHOWN = "Tj TJ ' \"".split()


def stream(rng, n):
    """Random operators, some of them without their operands, many of them saves and restores."""
    num = lambda: rng.choice(["0", "1", ".5", "-2.25", "12"])
    makers = [
        lambda: "q", lambda: "q", lambda: "Q", lambda: "Q", lambda: f"{num()} {num()} {num()} rg", lambda: f"{num()} g", lambda: f"{num()} G", lambda: f"{num()} {num()} {num()} {num()} k",
        lambda: "/DeviceRGB cs", lambda: "/Pattern CS", lambda: f"{num()} {num()} sc", lambda: f"{num()} /P1 scn", lambda: "/P2 SCN", lambda: f"{num()} w", lambda: f"{num()} J", lambda: f"[{num()} {num()}] {num()} d",
        lambda: f"/F{rng.randint(1, 3)} {num()} Tf", lambda: f"{num()} Tc", lambda: f"{num()} TL", lambda: f"{num()} {num()} TD", lambda: f"{num()} Tz", lambda: f"{rng.randint(0, 3)} Tr", lambda: "/Saturation ri",
        lambda: "1 2 rg", lambda: "w", lambda: "Tf", lambda: "cs", lambda: "(a) Tj", lambda: "(1 0 rg) Tj", lambda: "[(b) -3 (c)] TJ", lambda: "(d) '", lambda: f"{num()} {num()} (e) \"",
    ]
    return " ".join(rng.choice(makers)() for _ in range(n)).encode()


def test_state_like_the_fold(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for page in range(60):
        data = stream(rng, rng.choice([0, 5, 60, 300]))
        rows += [("d", page, seq, op, content.spelled(args), "kept") for seq, (op, args) in enumerate(content.tokens(data))]
        for e in content.fold(data):
            if e.kind == "text":
                want[page, e.seq] = e.state
    df = spark.createDataFrame(rows, "doc string, page int, seq int, op string, operands string, fill string").repartition(3)
    got = graphics.state_at(df, ["doc", "page"], F.col("op").isin(*SHOWN)).collect()
    assert {(r.page, r.seq) for r in got} == set(want) and len(got) == len(want) > 500
    for r in got:
        s = want[r.page, r.seq]
        assert (r.fill_space, *r.fill, *[x for x in [r.fill_pattern] if x]) == s.fill, (r, s)
        assert (r.stroke_space, *r.stroke, *[x for x in [r.stroke_pattern] if x]) == s.stroke
        assert (r.line_width, r.line_cap, r.char_space, r.word_space, r.leading, r.scale, r.mode, r.font, r.font_size, r.intent) == (s.line, s.cap, s.char, s.word, s.leading, s.scale, s.mode, s.font, s.size, s.intent)
        assert r.dash == f"[{' '.join(f'{x:g}' for x in s.dash[0])}] {s.dash[1]:g}"
    assert max(r.level for r in got) > 5
    assert graphics.state_at(df.limit(0), ["doc", "page"], F.lit(True)).collect() == []


def test_state_of_odd_rows(spark):
    rows = [(None, 0, "rg", "1 0 0"), (None, 1, "Q", None), (None, 2, "Tj", None), (1, 0, "Q", ""), (1, 1, "q", ""), (1, 2, "g", "1"), (1, 3, "Q", ""), (1, 4, "Tj", "(x)"), (1, 5, None, "1 0 0")]
    df = spark.createDataFrame(rows, "doc long, seq int, op string, operands string")
    got = {r.doc: (r.level, r.fill_space, r.fill) for r in graphics.state_at(df, ["doc"], F.col("op") == "Tj", ["fill_space", "fill"]).collect()}
    assert got == {None: (0, "DeviceRGB", [1.0, 0.0, 0.0]), 1: (0, "DeviceGray", [0.0])}


def test_no_exchange_but_by_page(spark):
    df = spark.createDataFrame([(1, 0, "q", "")], "doc long, seq int, op string, operands string")
    plan = graphics.state_at(df, ["doc"], F.col("op") == "Tj")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Python" not in plan


def boxes(rng, n, big):
    out = []
    for i in range(n):
        x, y = rng.uniform(-200, 900), rng.uniform(-200, 900)
        w, h = (rng.choice([0, 1, 30, 64, 256, 2000, big]) * rng.random() for _ in "xy")
        out.append((i, rng.choice(["a", "b", None]), *(float(round(v)) for v in (x, y, x + w, y + h))))
    return [*out, (n, "a", 0.0, 0.0, 0.0, 0.0), (n + 1, "a", 64.0, 64.0, 128.0, 128.0), (n + 2, "b", 5.0, 5.0, 4.0, 9.0), (n + 3, "a", None, 1.0, 2.0, 3.0)]


@pytest.mark.parametrize("big", [10, 1e6])
def test_boxes_like_all_pairs(spark, big):
    rng = random.Random(int(big))
    a, b = boxes(rng, 120, big), boxes(rng, 150, big)
    schema = "id int, k string, x0 double, y0 double, x1 double, y1 double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    sides = [("x0", "x1"), ("y0", "y1")]
    whole = lambda r: None not in r and r[2] <= r[4] and r[3] <= r[5]
    meet = lambda p, q: whole(p) and whole(q) and p[1] == q[1] and max(p[2], q[2]) <= min(p[4], q[4]) and max(p[3], q[3]) <= min(p[5], q[5])
    got = sorted((r.l.id, r.r.id) for r in spatial.overlapping(left, right, ["k"], sides, sides).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if meet(p, q)) and len(got) > 50
    assert spatial.overlapping(left.limit(0), right, ["k"], sides, sides).collect() == []
    plan = spatial.overlapping(left, right, ["k"], sides, sides)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_region_edges(spark):
    runs = spark.createDataFrame([("left", 10, 25), ("top", 15, 20), ("right", 20, 25), ("bottom", 15, 30), ("in", 15, 25), ("out", 0, 0)], "text string, x int, y int")
    regions = spark.createDataFrame([("one", 10, 20, 10, 10), ("two", 0, 0, 100, 100)], "region string, rx int, ry int, rw int, rh int")
    got = {(r.text, r.region) for r in spatial.in_regions(runs, regions).collect()}
    assert {t for t, r in got if r == "one"} == {"left", "in", "bottom"}  # y > top, y <= bottom
    assert {t for t, r in got if r == "two"} == {"left", "top", "right", "bottom", "in"}


def test_links_and_their_text(spark):
    keys = ["doc", "page"]
    links_ = spark.createDataFrame([(1, 0, 0, 10.0, 90.0, 60.0, 110.0, "u"), (1, 0, 1, 0.0, 0.0, 500.0, 200.0, "all"), (1, 0, 2, 0.0, 0.0, 1.0, 1.0, "none"), (1, 0, 3, 0.0, 0.0, 9.0, 9.0, None), (2, 0, 0, 10.0, 90.0, 60.0, 95.0, "turned"), (3, 0, 0, 0.0, 0.0, 9.0, 9.0, "no page"), (1, 0, 4, None, 0.0, 9.0, 9.0, "no area")], "doc int, page int, ord int, x0 double, y0 double, x1 double, y1 double, uri string")
    runs = spark.createDataFrame([(1, 0, 0, "b", 20.0, 100.0), (1, 0, 1, "a", 10.0, 100.0), (1, 0, 2, "edge", 60.0, 100.0), (1, 0, 3, "below", 10.0, 90.0), (1, 0, 4, "top", 10.0, 110.0), (2, 0, 0, "t", 20.0, 102.0)], "doc int, page int, seq int, text string, x double, y double")
    pages = spark.createDataFrame([(1, 0, 200.0, 0), (2, 0, 200.0, 90)], "doc int, page int, height double, rotate int")
    got = {(r.uri): (r.runs, r.text) for r in links.url_texts(links_, runs, pages, keys).collect()}
    assert got == {"u": (3, "a b\nbelow"), "all": (5, "top\na b edge\nbelow"), "none": (0, ""), "turned": (1, "t")}


def test_hits_and_their_runs(spark):
    rng = random.Random(5)
    rows = [(p, i, rng.choice(["the", "Other", "o", "the the", "", "😀the", None, "THE"]), i * 10, 100 - p, 5, 12) for p in range(20) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "page int, seq int, text string, x int, y int, width int, font_size int").repartition(3)
    words = ["the", "e t", "o+", r"\bo"]
    got = sorted((r.page, r.word, r.pos, r.len, r.runs, r["from"], r.to, r.x0, r.x1) for r in highlight.highlights(df, ["page"], ["seq"], words, F.lit(" ")).collect())
    want = []
    for p in range(20):
        text, spans = "", []
        for _, _, t, x, *_ in [r for r in rows if r[0] == p]:
            spans.append((len(text), len(text) + len(t or ""), x))
            text += (t or "") + " "
        for w in words:
            for m in re.finditer(w, text, re.I):
                met = [s for s in spans if s[0] < m.end() and s[1] > m.start() and s[0] < s[1]]
                want.append((p, w, m.start(), m.end() - m.start(), len(met), min((s[0] for s in met), default=None), max((s[1] for s in met), default=None), min((s[2] for s in met), default=None), max((s[2] + 5 for s in met), default=None)))
    assert got == sorted(want) and len(got) > 200
    with pytest.raises(ValueError):
        highlight.hits(df, ["page"], "text", ["x*"])


def test_words_of_lines(spark):
    """Against a list of words that is filled glyph by glyph."""
    from quire.operators import lines

    rng = random.Random(3)
    rows = [(i, k, rng.choice(["a", "bc", None, ""]), rng.random() < 0.35) for i in range(80) for k in range(rng.randint(0, 8))]
    want = []
    for i in range(80):
        words, now = [], ""
        for _, _, t, cut in [r for r in rows if r[0] == i]:
            if cut:
                words.append(now)
                now = ""
            else:
                now += t or ""
        want += [(i, n, w) for n, w in enumerate([*words, now] if now else words)]
    df = spark.createDataFrame(rows, "line int, k int, t string, cut boolean").repartition(3)
    got = lines.normalised(df, ["line"], "k", F.col("t"), F.col("cut"))
    assert sorted((r.line, r.word, r.text) for r in got.collect()) == want


def test_nested_emphasis_like_a_stack(spark):
    from quire.operators import lines

    rng = random.Random(7)
    rows = [(p, k, rng.random() < 0.5, rng.random() < 0.5) for p in range(60) for k in range(rng.randint(1, 25))]
    want = {}
    for p in range(60):
        held = []
        mine = [r for r in rows if r[0] == p]
        for _, k, bold, italic in mine:
            mark = ""
            for tag, on in (("**", bold), ("*", italic)):
                if on and tag not in held:
                    held.append(tag)
                    mark += tag
                elif not on and tag in held:
                    at = held.index(tag)
                    mark += "".join(reversed(held[at:]))
                    del held[at]
                    mark += "".join(held[at:])
            want[p, k] = (mark, "".join(reversed(held)) if k == mine[-1][1] else "")
    df = spark.createDataFrame(rows, "page int, k int, b boolean, i boolean").repartition(3)
    got = lines.nested_emphasis(df, ["page"], ["k"], F.col("b"), F.col("i"))
    assert {(r.page, r.k): (r.mark, r.close) for r in got.collect()} == want


def test_strict_and_loose_overlaps(spark):
    from quire.operators import layout

    rows = [(0, 0, 0, "ab", 10.0, 5.0, 12.0, 10.0), (0, 0, 1, "ab", 12.0, 5.0, 12.0, 10.0), (0, 0, 2, "ab", 11.9, 5.0, 12.0, 10.0), (0, 0, 3, "z", 1.0, 1.0, 0.0, 10.0), (0, 0, 4, "z", 1.0, 1.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, seq long, text string, x double, y double, width double, font_size double")
    assert sorted(r.seq for r in layout.suppress_overlaps(df, strict=True).collect()) == [0, 1, 3, 4]
    assert sorted(r.seq for r in layout.suppress_overlaps(df).collect()) == [0, 3]


def test_separators_around_and_between(spark):
    from quire.operators import layout

    rows = [(1, 0, 0, 0, 1, "b", False), (1, 0, 0, 0, 0, "a", False), (1, 0, 0, 1, 0, "c", True), (1, 0, 1, 2, 0, None, None), (1, 1, 0, 0, 0, "d", True), (2, 0, 0, 0, 0, "x", False)]
    df = spark.createDataFrame(rows, "doc int, page int, article int, line int, word int, text string, paragraph boolean").repartition(3)
    plain = {r.doc: r.text for r in layout.document_text(df, ["doc"]).collect()}
    assert plain == {1: "a b\nc\nd\n", 2: "x\n"}
    marks = {k: f"<{k}>" for k in layout.SEPARATORS}
    got = {r.doc: r.text for r in layout.document_text(df, ["doc"], **marks).collect()}
    assert got[2] == "<page_start><article_start><paragraph_start>x<paragraph_end><article_end><page_end>"
    assert got[1] == "<page_start><article_start><paragraph_start>a<word>b<line><paragraph_end><paragraph_start>c<paragraph_end><article_end><article_start><paragraph_start><paragraph_end><article_end><page_end><page_start><article_start><paragraph_start>d<paragraph_end><article_end><page_end>"
    with pytest.raises(ValueError):
        layout.document_text(df, ["doc"], words="")


def test_operators_of_streams_like_the_tokenizer(spark):
    """The same operators as the reader's, and the same state at each; strings, comments, images and odd brackets among them."""
    from quire.operators import tokens

    rng = random.Random(21)
    odd = [b"(a (b) \\) c) Tj", b"% a comment q Q\nq", b"<</A [1 2] /B <</C (x)>>>> /P BDC"[::1], b"] q", b">> Q", b"(\\\\) Tj", b"<48 65> Tj", b"[(x)(y)-3<41>]TJ", b"true /N gs", b"1 0 0 rg/F1 9 Tf", b"BI /W 1 /H 1 ID \x01q Q\xff EI", b"(" + b"long \\( " * 3000 + b") Tj", b"(((deep))) '"]
    rows, want, states = [(999, b""), (998, None)], {}, {}
    for page in range(50):
        parts = stream(rng, rng.choice([0, 8, 40])).split(b" ") if page % 2 else []
        data = b" ".join([*parts, *rng.choices(odd, k=rng.randint(0, 6))]) if page % 2 == 0 else b" ".join(parts)
        rows.append((page, data))
        want[page] = [op for op, _ in content.tokens(data)]
        states |= {(page, e.seq): e.state for e in content.fold(data) if e.kind == "text"}
    df = spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in rows], "page int, content binary").repartition(3)
    ops = tokens.operators(df, ["page"], "content")
    got = {}
    for r in sorted(ops.collect(), key=lambda r: (r.page, r.seq)):
        got.setdefault(r.page, []).append(r.op)
        assert r.seq == len(got[r.page]) - 1
    assert got == {p: o for p, o in want.items() if o}
    at = {(r.page, r.seq): r for r in graphics.state_at(ops, ["page"], F.col("op").isin(*SHOWN)).collect()}
    assert set(states) <= set(at)
    for k, s in states.items():
        assert (at[k].fill_space, *at[k].fill, *[x for x in [at[k].fill_pattern] if x]) == s.fill and (at[k].line_width, at[k].font, at[k].font_size) == (s.line, s.font, s.size), k


def test_regions_and_few_boxes_copy_no_run(spark):
    """Regions under broadcast shuffle nothing, and the side of the many stands in cells of the levels in use."""
    runs = spark.range(2000).selectExpr("id", "id % 7 AS k", "CAST(id % 600 AS DOUBLE) AS x", "CAST(id % 800 AS DOUBLE) AS y")
    regions = spark.createDataFrame([(2, 0, 0, 300, 300), (1, 100, 100, 20, 20), (3, 0, 0, 9000, 9000)], "bead int, rx int, ry int, rw int, rh int")
    got = spatial.first_region(runs, ["id"], regions, "bead")
    want = {r.id: min([b for b, x, y, w, h in ((2, 0, 0, 300, 300), (1, 100, 100, 20, 20), (3, 0, 0, 9000, 9000)) if x <= r.x < x + w and y < r.y <= y + h], default=None) for r in runs.collect()}
    assert {r.id: r.bead for r in got.collect()} == want and {1, 2, 3} <= set(want.values())
    for df in (got, spatial.in_regions(runs, F.broadcast(regions))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= plan.count("collect_list")
    nulls = runs.withColumn("x", F.when(F.col("id") > 9, F.col("x")))
    assert spatial.first_region(nulls, ["id"], regions, "bead").count() == 2000
    boxes = spark.createDataFrame([(1, 10.0, 50.0), (2, 0.0, 5000.0)], "k long, lo double, hi double")
    many = runs.select("k", "id", "x")
    pairs = spatial.overlapping(many, boxes, ["k"], [("x", "x")], [("lo", "hi")], few="r")
    assert pairs.count() == many.where("(k = 1 AND x BETWEEN 10 AND 50) OR k = 2").count()
    cells = spatial._cells(many, [("x", "x")], spatial.WIDTHS, "l", [0])
    assert cells.count() == 2000  # and not one for each of four levels


def test_overlaps_like_brute_force(spark):
    """Against every kept run in turn; the query reads its documents once."""
    from quire.operators import layout
    from quire.plans import catalog

    rng = random.Random(3)
    rows = []
    for n in range(600):
        text, width = rng.choice(["", "a", "ab", "abc"]), rng.choice([0.0, 6.0, 12.0, 30.0])
        rows.append((rng.randint(1, 3), rng.randint(0, 1), text, n, rng.randint(0, 120) / 2, rng.choice([0.0, 1.0, 3.0, 40.0]), width, rng.choice([0.0, 12.0])))
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, text string, seq int, x double, y double, width double, font_size double")
    for strict in (False, True):
        kept = []
        for r in sorted(rows, key=lambda r: r[3]):
            d, p, t, _, x, y, w, size = r
            tol = w / max(1, len(t)) / 3 if strict or (w > 0 and t) else max(size, 0.1) * 0.25
            inside = lambda a, b: abs(x - a) < tol and abs(y - b) < tol if strict else x - tol <= a < x + tol and y - tol <= b < y + tol  # noqa: B023, E731
            if not any(k[:3] == (d, p, t) and inside(k[4], k[5]) for k in kept):
                kept.append(r)
        assert sorted(r.seq for r in layout.suppress_overlaps(df, strict).collect()) == [k[3] for k in kept]
    for query in ("dup_overlap_suppress", "marked_overlaps"):
        plan = catalog.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1


def test_rows_of_shown_strings_have_one_state(spark):
    """strings that follow each other are one row with their number, and its state is that of each of them."""
    from quire.plans import marks
    from quire.plans.pdfs import made
    from quire.sources import objects as O
    from quire.sources import pdf
    from quire.sources.objects import Name, Ref

    docs = made(spark, "/root/testdata/sf0.001").cache()
    each, few = pdf.operators(docs, "doc_id"), pdf.stretches(docs, "doc_id")
    assert few.agg(F.sum("n")).first()[0] == each.count() > 5 * few.count()
    state = lambda ops, n: graphics.state_at(ops, ["doc_id", "page_idx"], F.col("op").isin(*SHOWN, "f")).groupBy("doc_id", "page_idx", "op", "level", "fill", "font", "line_width").agg(n.alias("n"))
    assert state(each, F.count("*")).exceptAll(state(few, F.sum("n"))).isEmpty()
    docs.unpersist()
    plan = marks.pdf_text_colours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "miter_limit" not in plan and "MapInArrow" in plan
    data = b"BT /F 9 Tf [<41>] TJ [<42>] TJ 1 g [(a) 2]TJ [<43>] TJ q 3 [<44> <45>] TJ (x) Tj Q [<4>] TJ ET"
    file = O.write({1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Kids": [Ref(3)], "Count": 1}, 3: {"Contents": Ref(4)}, 4: O.flate(data)}, 1)
    rows = list(pdf.Rows(lambda d, k: pdf.stretches(d, k)).rows(file))
    assert [r[2] for r in rows for _ in range(r[4])] == [op for op, _ in content.tokens(data)] and rows[2][1:] == (2, "TJ", None, 2) and rows[3][3] == "1"


def test_hits_and_link_texts_join_and_shuffle_no_runs(spark):
    """the texts are dealt once by document, and a page's runs are gathered where they are."""
    from quire.plans import marks

    plan = marks.search_highlights(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = marks.link_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and plan.count("Exchange") == plan.count("FileScan") == plan.count("REPARTITION_BY_NUM")
    # a null among the keys: the hit is there, and no run is touched
    rows = spark.createDataFrame([(None, 0, "the", 1, 2, 3, 4), (1, 0, "the", 1, 2, 3, 4), (1, 1, "x", None, 2, None, 4), (1, 2, "the", None, 2, 3, 4)], "page int, seq int, text string, x int, y int, width int, font_size int")
    got = highlight.highlights(rows, ["page"], ["seq"], ["the"], F.lit(" "))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "the", 0, 3, 1, 0, 3, 1, 2, 4, 6), (1, "the", 6, 3, 1, 6, 9, None, 2, None, 6), (None, "the", 0, 3, 0, None, None, None, None, None, None)]
    assert highlight.highlights(rows.limit(0), ["page"], ["seq"], ["the"], F.lit(" ")).collect() == []
