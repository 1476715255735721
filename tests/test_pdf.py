"""PDF bytes: files built here, read back by their cross-references and by recovery; content, fonts and character maps."""

import random
import zlib

import pyarrow as pa
import pytest

from quire.functions import cmaps, unicode_text
from quire.functions import structure as S
from quire.operators import assemble, paragraphs
from quire.plans import pdfs
from quire.sources import catalog, content, pdf
from quire.sources import objects as O
from quire.sources.objects import File, Name, Parser, Ref, Stream

PAGE = {
    1: {"Type": Name("Catalog"), "Pages": Ref(2)},
    2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1, "MediaBox": [0, 0, 612, 792], "Rotate": 90},
    3: {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(4)},
    4: O.flate(b"BT /F1 12 Tf 72 700 Td (Hello) Tj ET"),
}


@pytest.mark.parametrize(
    ("source", "want"),
    [(b"(a(b)c\\)\\n\\101\\\n)", b"a(b)c)\nA"), (b"<48 65 6>", b"He`"), (b"/A#20B", "A B"), (b"[1 -2.5 .5 true null /x (y)]", [1, -2.5, 0.5, True, None, "x", b"y"]), (b"<</a 1/b[2 0 R]/c<</d(e)>>>>", {"a": 1, "b": [Ref(2)], "c": {"d": b"e"}}), (b"% note\n7", 7), (b"<</a 1 2 /b 3>>", {"a": 1, "b": 3}), (b"[1 2", [1, 2])],
)
def test_values(source, want):
    assert Parser(source).value() == want


def test_values_survive_a_round_trip():
    rng = random.Random(2)

    def any_value(depth):
        k = rng.randrange(8 if depth else 6)
        return [None, True, rng.randint(-99, 99), round(rng.uniform(-9, 9), 3), rng.randbytes(5), Name(rng.choice(["A", "b c", "#", "é/"])), [any_value(depth - 1) for _ in range(3)] if depth else 0, {f"k{i}": any_value(depth - 1) for i in range(2)} if depth else 0][k]

    for _ in range(300):
        v = any_value(3)
        assert Parser(O.dump(v)).value() == v


@pytest.mark.parametrize("packed", [0, 2])
def test_updates_and_recovery(packed):
    first = O.write(PAGE, 1, packed)
    both = O.write({3: {"Type": Name("Page"), "Parent": Ref(2), "Contents": [Ref(4), Ref(25)]}, 25: Stream({}, b"0 0 m 5 5 l S")}, 1, packed, before=first, prev=O.last_section(first), free=30)
    for data, recovered in ((first, False), (both, False), (both.replace(b"startxref", b"startyref"), True)):
        f = File.open(data)
        assert f.recovered is recovered
        assert len(f.pages()) == 1 and f.pages()[0]["Rotate"] == 90 and f.version == "1.5"
        shown = f.content(f.pages()[0])
        assert shown.startswith(b"BT /F1") and shown.endswith(b"S") is (data is not first)
    assert [k for k, _ in File.open(both).sections] == ["stream" if packed else "table"] * 2


def test_recovery_rules():
    data = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Kids[]>>\nendobj\n7 1 obj\n(new)\nendobj\n7 0 obj\n(old)\nendobj\n8 0 obj (a) endobj 8 0 obj (b) endobj xobj 9 0 object"
    f = File.open(data)
    assert f.recovered and f.get(Ref(7)) == b"new" and f.get(Ref(8)) == b"b" and f.get(Ref(9)) is None and f.get(f.trailer["Root"])["Type"] == "Catalog"
    loop = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Kids": [Ref(2), Ref(3)]}, 3: {"Type": Name("Page")}}
    assert len(File.open(O.write(loop, 1)).pages()) == 1
    for junk in (b"", b"%PDF-1.7", b"startxref\n99999\n%%EOF", random.Random(1).randbytes(4000)):
        assert File.open(junk).pages() == []


def test_streams():
    long = b"9 0 obj <</Length 99>> stream\r\nabc\r\nendstream endobj"
    assert Parser(long).indirect()[2].raw == b"abc"
    assert Parser(b"9 0 obj <</Length 3>> stream\nabc\nendstream").indirect()[2].raw == b"abc"
    rows = zlib.compress(bytes([2, 1, 0, 9, 2, 0, 1, 0]))
    s = Stream({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 3}}, rows)
    assert s.data() == bytes([1, 0, 9, 1, 1, 9])
    assert O.xref_rows(bytes([1, 0, 9, 0, 2, 0, 5, 3, 0, 0, 0, 0, 1]), [1, 2, 1], [3, 9]) == [(3, 1, 9, 0), (4, 2, 5, 3)]
    assert O.xref_rows(bytes([0, 7]), [0, 1, 1], [5, 1]) == [(5, 1, 0, 7)]


def test_tokens():
    got = list(content.tokens(b"/P <</MCID 0>> BDC BI /W 1 /H 2 ID \x00\x01\nEI Q (a) Tj % c\n[(b) -20 <63>] TJ"))
    assert got == [("BDC", ["P", {"MCID": 0}]), ("BI", []), ("ID", [{"W": 1, "H": 2}]), ("EI", [b"\x00\x01"]), ("Q", []), ("Tj", [b"a"]), ("TJ", [[b"b", -20, b"c"]])]


def facts(data, kind, **more):
    return [e for e in content.fold(data, **more) if e.kind == kind]


def test_text_state():
    data = b"2 0 0 2 5 5 cm BT /F 10 Tf 1 Tc 2 Tw 50 Tz 12 TL 3 Ts 1 Tr 100 200 Td (a b) Tj (c) Tj T* (d) Tj 5 6 (e) \" (f) ' 0 -14 TD [100 (g) -100 (h)] TJ 1 0 0 1 7 8 Tm (i) Tj ET"
    got = {e.facts["text"]: e for e in facts(data, "text")}
    one = (5.0 + 1) * 0.5  # half the size and one unit between characters, at half the width
    assert [got["a b"].facts[k] for k in ("x", "y", "font_size")] == [205.0, 411.0, 20.0] and got["a b"].state.mode == 1
    assert got["a b"].facts["width"] == pytest.approx(2 * (3 * one + 2 * 0.5))
    assert got["c"].facts["x"] == pytest.approx(205 + 2 * (3 * one + 1))
    assert (got["d"].facts["x"], got["d"].facts["y"]) == (205.0, 411 - 24)
    assert got["e"].state.char == 6 and got["e"].state.word == 5 and got["f"].facts["y"] == 411 - 72
    assert got["gh"].facts["y"] == 411 - 72 - 28 and got["gh"].facts["x"] == pytest.approx(205 - 2 * 0.5)
    assert (got["i"].facts["x"], got["i"].facts["y"]) == (19.0, 5 + 2 * 11)


@pytest.mark.parametrize(
    ("data", "rule", "stroked", "segments", "box"),
    [(b"0 0 m 10 0 l 10 20 l s", "", True, "mllh", [0, 0, 10, 20]), (b"1 2 3 4 re f", "nonzero", False, "mlllh", [1, 2, 4, 6]), (b"1 2 3 4 re F", "nonzero", False, "mlllh", [1, 2, 4, 6]), (b"1 2 3 4 re f*", "evenodd", False, "mlllh", [1, 2, 4, 6]), (b"0 0 m 1 1 2 2 3 3 c 4 4 5 5 v 6 6 7 7 y S", "", True, "mccc", [0, 0, 7, 7]), (b"0 0 m 1 0 l h B", "nonzero", True, "mlh", [0, 0, 1, 0]), (b"0 0 m 1 0 l B*", "evenodd", True, "ml", [0, 0, 1, 0]), (b"0 0 m 1 0 l b", "nonzero", True, "mlh", [0, 0, 1, 0]), (b"0 0 m 1 0 l b*", "evenodd", True, "mlh", [0, 0, 1, 0]), (b"0 0 5 5 re W n", "", False, "mlllh", [0, 0, 5, 5])],
)
def test_paths(data, rule, stroked, segments, box):
    (e,) = facts(data, "path")
    assert (e.facts["rule"], e.facts["stroked"], e.facts["segments"], e.facts["box"]) == (rule, stroked, segments, box)


@pytest.mark.parametrize(
    ("data", "name", "want"),
    [(b"0.5 g", "fill", ("DeviceGray", 0.5)), (b"1 0 0 rg", "fill", ("DeviceRGB", 1, 0, 0)), (b"0 0 0 1 k", "fill", ("DeviceCMYK", 0, 0, 0, 1)), (b"0.5 G", "stroke", ("DeviceGray", 0.5)), (b"1 0 0 RG", "stroke", ("DeviceRGB", 1, 0, 0)), (b"0 0 0 1 K", "stroke", ("DeviceCMYK", 0, 0, 0, 1)),
     (b"/Lab cs 1 2 3 sc", "fill", ("Lab", 1, 2, 3)), (b"/Pattern cs /P1 scn", "fill", ("Pattern", "P1")), (b"/Lab CS 1 2 3 SC", "stroke", ("Lab", 1, 2, 3)), (b"/Pattern CS 1 /P1 SCN", "stroke", ("Pattern", 1, "P1")), (b"/DeviceRGB cs", "fill", ("DeviceRGB", 0, 0, 0)),
     (b"3 w", "line", 3), (b"1 J", "cap", 1), (b"2 j", "join", 2), (b"4 M", "miter", 4), (b"[1 2] 3 d", "dash", ((1, 2), 3)), (b"/Perceptual ri", "intent", "Perceptual"), (b"9 i", "flat", 9), (b"/G1 gs", "named", "G1"), (b"q 3 w Q", "line", 1), (b"Q 3 w", "line", 3), (b"rg 1 rg", "fill", ("DeviceGray", 0.0)), (b"0 0 9 9 re W n", "clip", 1)],
)
def test_graphics_state(data, name, want):
    assert getattr(facts(data + b" 0 0 m 1 1 l S", "path")[-1].state, name) == want


def test_marked_content_objects_and_images():
    data = b"/A BMC /B <</MCID 3>> BDC (x) Tj EMC /C /known BDC (y) Tj EMC /D /unknown BDC (z) Tj EMC EMC EMC /P MP /Q <</MCID 4>> DP q 10 0 0 20 1 2 cm /Im Do BI /W 1 ID ab EI Q /Sh sh"
    got = {e.facts["text"]: [(m[0], m[1]) for m in e.marks] for e in facts(data, "text", properties={"known": {"MCID": 5}})}
    assert got == {"x": [("A", None), ("B", 3)], "y": [("A", None), ("C", 5)], "z": [("A", None)]}
    assert [(e.facts["name"], e.facts["mcid"]) for e in facts(data, "point")] == [("P", None), ("Q", 4)]
    assert facts(data, "object")[0].facts == {"name": "Im", "box": [1, 2, 11, 22]} and facts(data, "image")[0].facts["bytes"] == 2 and facts(data, "shading")[0].facts["name"] == "Sh"


def test_character_maps():
    m = cmaps.parse(b"/WMode 1 def 2 begincodespacerange <00><80> <8140><9ffc> endcodespacerange 3 beginbfrange <0000><005e><0020> <005f><0061>[<00660066><00660069><00660066006C>] <0109><0100><0041> endbfrange 1 beginbfchar<3A51><D840DC3E>endbfchar 2 begincidrange <0010><0020>500<8140><817e>633 endcidrange 1 begincidchar <0030> 7 endcidchar")
    assert [m.text(c) for c in (b"\x00\x21", b"\x00\x60", b"\x3a\x51", b"\x01\x05", b"\x21")] == ["A", "fi", "\U0002003e", None, None]
    assert [m.cid(c) for c in (b"\x00\x11", b"\x81\x41", b"\x00\x30", b"\x11")] == [501, 634, 7, -1] and m.vertical
    assert m.codes(b"A\x81\x40B") == [b"A", b"\x81\x40", b"B"]
    over = b"1 beginbfrange <0232><0432><01f0> endbfrange"
    assert cmaps.parse(over).text(b"\x03\x00") is not None and cmaps.parse(over, strict=True).text(b"\x03\x00") is None and cmaps.parse(over, strict=True).text(b"\x02\x41") == "\u01ff"
    assert [cmaps.glyph_text(x) for x in ("A", "eacute", "uni20AC", "u1F600", "space", "percent", "nine.alt", "nope", "germandbls")] == ["A", "é", "€", "\U0001f600", " ", "%", "9", None, "ß"]
    assert cmaps.encoding("WinAnsiEncoding")[0x80] == "€" and cmaps.encoding("MacRomanEncoding")[0x8E] == "é"


def test_fonts():
    f = File.open(O.write(PAGE, 1))
    simple = pdf.font(f, "F", {"Subtype": Name("TrueType"), "FirstChar": 65, "Widths": [700, 800], "Encoding": {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [66, Name("eacute"), Name("uni20AC")]}})
    assert simple.glyphs(b"ABCD") == [("A", 700.0, False), ("é", 800.0, False), ("€", 0.0, False), ("D", 0.0, False)]
    wide = pdf.font(f, "F", {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"W": [1, [300, 400], 5, 7, 900], "DW": 250}]})
    assert [w for _, w, _ in wide.glyphs(bytes([0, 1, 0, 2, 0, 6, 0, 9]))] == [300, 400, 900, 250]


def test_relations(spark):
    good = O.write(PAGE, 1, packed=2)
    docs = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no file")), ("c", None)], "path string, content binary")
    assert {(r.path, r.pages, r.error) for r in pdf.documents(docs).collect()} == {("a", 1, None), ("b", 0, None)}
    assert [(r.text, r.x, r.y, r.font) for r in pdf.runs(docs).collect()] == [("Hello", 72.0, 700.0, "F1")]
    assert sorted((r.src, r.dst) for r in pdf.references(docs).collect() if r.src < 5) == [(1, 2), (2, 3), (3, 2), (3, 4)]
    assert {(r.num, r.place) for r in pdf.objects(docs).collect()} >= {(1, "at"), (2, "in"), (3, "in"), (4, "at")}
    assert [(r.page_idx, r.width, r.height, r.rotate) for r in pdf.pages(docs).collect()] == [(0, 612.0, 792.0, 90)]
    assert [r.content for r in pdf.sub_range(docs.where("path = 'b'"), 3, 99).collect()] == [b"file"]
    assert pdf.documents(docs.limit(0)).collect() == []


def test_built_files_are_alike():
    text = "Some words\n\n  and  more é \U0001f600\n" + "\n".join(f"line {i}" for i in range(45))
    said = [[e.facts["text"] for _, e in pdf.events(File.open(pdfs.build(k, text))) if e.kind == "text"] for k in range(4)]
    assert said[0] == said[1] == said[2] == said[3] == text.split()


def run(text, x, y, width=10.0, size=12.0, height=8.0, space=8.0, **more):
    return paragraphs.Run(text, x, y, width, height, size, space, **more)


def test_layout_rules():
    order = paragraphs.reading_order([run("c", 5, 80), run("b", 50, 100.05), run("a", 5, 100), run("up", 1, 1, dir=90.0)])
    assert [r.text for r in order] == ["a", "b", "c", "up"]
    assert [[r.text for r in x] for x in paragraphs.lines([run("a", 0, 100), run("b", 9, 97), run("c", 0, 80)])] == [["a", "b"], ["c"]]
    for x, gap in ((27.9, False), (28.1, True)):
        assert paragraphs.breaks([run("a", 10, 0, width=6, size=8), run("b", x, 0, size=8)]) == [False, gap]
    for x, gap in ((37.9, False), (50.1, True)):
        assert paragraphs.breaks([run("abcd", 10, 0, width=0, size=8), run("b", x, 0, size=8)]) == [False, gap]
    for dy, kind in ((35, "start"), (20, "")):
        assert paragraphs.paragraphs([run("a", 0, 100), run("b", 0, 100 - dy)]) == ["start", kind]
    for dx, kind in ((17, "hanging"), (15, "")):
        assert paragraphs.paragraphs([run("a", 0, 100), run("b", dx, 88)]) == ["start", kind]
    assert paragraphs.paragraphs([run("1.", 0, 100), run("2.", 0, 88), run("x", 0, 76)]) == ["start", "start", ""]
    assert paragraphs.paragraphs([run("a", 0, 100), run("b", 20, 88), run("c", 20, 76), run("d", 5, 64)]) == ["start", "hanging", "hanging", "start"]


def test_characters():
    assert unicode_text.presentation("ﬁn ½") == "fin ½" and unicode_text.merged("e", "´") == "é" and unicode_text.merged("x", "´") == "x\u0301"
    assert [unicode_text.is_diacritic(c) for c in ("\u0301", "´", "ー", "a", "ab")] == [True, True, False, False, False]
    assert unicode_text.logical("abc") == "abc" and unicode_text.right_to_left("1 \u05d0") and not unicode_text.right_to_left("a\u05d0")
    assert unicode_text.logical("12 \u05d1\u05d0") == "\u05d0\u05d1 12" and unicode_text.logical("ab \u05d1\u05d0 cd") == "ab \u05d0\u05d1 cd"
    assert unicode_text.prepared("I\u00adX\u00a0\u2168") == "IX IX" and unicode_text.utf16(b"\xd8\x00\x00") == "\ufffd"
    with pytest.raises(ValueError):
        unicode_text.prepared("\u0007")


@pytest.mark.parametrize("revision", [2, 3, 4])
def test_passwords(revision):
    n, ident = 5 if revision == 2 else 16, b"0123456789abcdef"
    owner = S.owner_entry(b"owner", b"user", revision, n)
    user = S.user_entry(S.file_key(b"user", owner, -44, ident, revision, n), ident, revision)
    key = S.opens(b"user", user, owner, -44, ident, revision, n)
    assert key and len(key) == n and S.opens(b"other", user, owner, -44, ident, revision, n) is None
    assert len(S.object_key(key, 12, 0)) == min(n + 5, 16) and S.object_key(key, 12, 0) != S.object_key(key, 12, 0, aes=True)


def test_metadata_and_forms():
    with pytest.raises(ValueError):
        list(S.xmp_rows(b"<!DocType a><a/>"))
    with pytest.raises(ValueError):
        list(S.xfdf_rows(b"<fdf/>"))
    nested = b'<xfdf><fields><field name="a"><value>1</value><field name="b"><value>2</value></field></field></fields></xfdf>'
    assert list(S.xfdf_rows(nested)) == [("a", "1"), ("a.b", "2")]


def shown(data):
    f = File.open(data)
    return [[e.facts["text"] for i, e in pdf.events(f) if i == k and e.kind == "text"] for k in range(len(f.pages()))]


def test_merge_split_and_decode():
    a, b = pdfs.build(1, "\n".join(f"line {i}" for i in range(50))), pdfs.build(2, "other text")
    both = assemble.merged([a, b"junk", b])
    assert shown(both) == shown(a) + shown(b) and len(shown(both)) == 4
    parts = assemble.split(both, 3)
    assert [len(shown(x)) for x in parts] == [3, 1] and shown(parts[0]) + shown(parts[1]) == shown(both)
    assert len(parts[1]) < len(both) / 2  # what the pages don't reach stays behind
    assert [shown(x) for x in assemble.split(both, 1, 2, 3)] == [[p] for p in shown(both)[1:3]] and assemble.split(both, 2, 9) == []
    plain = assemble.decoded(a)
    assert shown(plain) == shown(a) and b"FlateDecode" not in plain and b"ObjStm" not in plain
    for bad in ((0, 1, None), (1, 0, None), (1, 3, 2)):
        with pytest.raises(ValueError):
            assemble.split(a, *bad)


RICH = {
    1: {"Type": Name("Catalog"), "Pages": Ref(2), "Outlines": Ref(10), "Dests": {"old": [Ref(4), Name("Fit")]}, "Names": {"Dests": {"Kids": [Ref(20)]}, "EmbeddedFiles": {"Names": [b"n", {"F": b"n.txt", "EF": {"F": Ref(21)}}]}}, "PageLabels": {"Nums": [0, {"S": Name("r")}, 1, {"P": b"A-"}]}, "StructTreeRoot": Ref(30), "AcroForm": {"Fields": [Ref(40)]}, "Metadata": Ref(50)},
    2: {"Type": Name("Pages"), "Kids": [Ref(3), Ref(4)], "Count": 2},
    3: {"Type": Name("Page"), "Parent": Ref(2), "Annots": [{"Subtype": Name("Link"), "Rect": [9, 9, 1, 2], "A": {"S": Name("URI"), "URI": b"http://x"}}, {"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "Dest": b"new"}, None, 7]},
    4: {"Type": Name("Page"), "Parent": Ref(2)},
    10: {"First": Ref(11)}, 11: {"Title": b"\xfe\xff\x00\xe9", "Dest": Name("old"), "A": {"D": [Ref(3)]}, "First": Ref(12), "Next": Ref(13)}, 12: {"Title": b"in", "A": {"S": Name("GoTo"), "D": b"new"}, "Next": Ref(11)}, 13: {"Title": b"lost", "Dest": b"nowhere"},
    20: {"Names": [b"new", {"D": [Ref(4), Name("Fit")]}]}, 21: O.flate(b"note"),
    30: {"K": [Ref(31)], "RoleMap": {"Mine": Name("Sect"), "Sect": Name("Div"), "Div": Name("Mine")}}, 31: {"S": Name("Mine"), "K": [0, {"Type": Name("MCR"), "Pg": Ref(4), "MCID": 5}, Ref(32)], "Pg": Ref(3)}, 32: {"S": Name("P"), "Alt": b"alt", "K": [Ref(31)]},
    40: {"T": b"a", "FT": Name("Tx"), "Ff": 2, "Kids": [Ref(41), Ref(42)]}, 41: {"T": b"b", "V": b"x<"}, 42: {"T": b"s", "FT": Name("Sig"), "V": {"Filter": Name("Own"), "ByteRange": [0, 4, 6, 3]}},
    50: Stream({}, b'<x><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><r:Description r:about="" xmlns:d="urn:d"><d:t><r:Seq><r:li>1</r:li></r:Seq></d:t></r:Description></r:RDF></x>'),
    60: {"Title": b"T", "Empty": b""},
}


def test_catalog_relations(spark):
    import hashlib

    data = O.write(RICH, 1, packed=4, info=60)
    docs = spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(b"junk"))], "path string, content binary")

    def rows(make, *cols):
        return [tuple(r[c] for c in cols) for r in make(docs).collect()]

    assert rows(catalog.info, "name", "value") == [("Title", "T")]
    assert rows(catalog.bookmarks, "ord", "depth", "title", "page_idx") == [(0, 0, "é", 1), (1, 1, "in", 1), (2, 0, "lost", None)]
    assert rows(catalog.annotations, "page_idx", "subtype", "x0", "y1", "uri", "to_page") == [(0, "Link", 1.0, 9.0, "http://x", None), (0, "Link", 0.0, 1.0, None, 1)]
    assert rows(catalog.fields, "name", "kind", "flags", "value", "terminal") == [("a", "Tx", 2, None, False), ("a.b", "Tx", 2, "x<", True), ("a.s", "Sig", 2, "{'Filter': 'Own', 'ByteRange': [0, 4, 6, 3]}", True)]
    assert rows(catalog.label_ranges, "start_idx", "style", "prefix", "first") == [(0, "r", None, 1), (1, None, "A-", 1)]
    assert rows(catalog.attachments, "name", "file", "size", "sha256") == [("n", "n.txt", 4, hashlib.sha256(b"note").hexdigest())]
    assert rows(catalog.structure, "ord", "parent", "role", "standard", "page_idx", "mcid", "alt") == [(0, None, "Mine", "Mine", 0, None, None), (1, 0, None, None, 0, 0, None), (2, 0, None, None, 1, 5, None), (3, 0, "P", "P", 0, None, "alt")]
    assert rows(catalog.signatures, "name", "filter", "covered", "sha256") == [("s", "Own", 7, hashlib.sha256(data[:4] + data[6:9]).hexdigest())]
    assert [(r.property, r.container, r.value) for r in S.xmp(catalog.packets(docs), "path").collect()] == [("t", "Seq", "1")]


def test_commands(spark, tmp_path, capsys):
    import json

    from quire import cli

    (tmp_path / "a.pdf").write_bytes(pdfs.build(1, "First line\nand more"))
    (tmp_path / "b.pdf").write_bytes(pdfs.build(3, "Second"))
    paths = [str(tmp_path / "*.pdf")]

    def said(*args):
        assert cli.main(list(args)) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert [x["text"] for x in said("extracttext", *paths)] == ["First line\nand more", "Second"]
    assert [(x["pages"], x["info"]["Title"]) for x in said("info", *paths)] == [(1, "T 1"), (1, "T 3")]
    assert [x["uri"] for x in said("urls", *paths)] == ["http://x.org/1/0", "http://x.org/3/0"]
    for verb in ("listbookmarks", "listfields", "exportxfdf", "attachments", "colours", "fonts", "labels", "pages", "markdown", "images", "objects", "operators", "sections", "references", "signatures", "structure", "xmp"):
        said(verb, *paths)
    for verb, n in (("merge", 1), ("split", 2), ("decode", 2)):
        assert said(verb, *paths, "--out", str(tmp_path / verb))[0]["files"] == n
        got = spark.read.parquet(str(tmp_path / verb))
        assert sorted(w for r in got.collect() for p in shown(r.content) for w in p) == ["First", "Second", "and", "line", "more"]


def test_usual_tokens_need_no_parser_and_others_are_as_by_it(monkeypatch):
    from quire.sources import content
    from quire.sources.objects import Parser

    called, value = [], Parser.value
    monkeypatch.setattr(Parser, "value", lambda self, refs=True: called.append(1) or value(self, refs))
    usual = b"q 1 0 0 -.5 0 7. cm /P <</MCID 3>> BDC /F1 12 Tf [<0102> -500 <0a>] TJ [] TJ <41> Tj EMC Q f*"
    assert list(content.tokens(usual)) == [("q", []), ("cm", [1, 0, 0, -0.5, 0, 7.0]), ("BDC", ["P", {"MCID": 3}]), ("Tf", ["F1", 12]), ("TJ", [[b"\1\2", -500, b"\n"]]), ("TJ", [[]]), ("Tj", [b"A"]), ("EMC", []), ("Q", []), ("f*", [])]
    assert not called
    # odd digits, a string or a comment in an array, what only looks like a number, values that are words, an image
    odd = b"[<414> 1] TJ [(a\\)) %]\n 2] TJ [1.2.3 --4] TJ /A#20B gs true null 1.2.3 x [1 2]]TJx 5TJ <</A 1/B 2>> DP BI /W 1 ID a]TJ EI [3] TJ% no\n<4"
    monkeypatch.setattr(content, "_USUAL", content.re.compile(rb"(?!)"))
    slow = list(content.tokens(odd))
    monkeypatch.undo()
    assert repr(list(content.tokens(odd))) == repr(slow) and list(content.tokens(usual))[2] == ("BDC", ["P", {"MCID": 3}])


def test_what_is_not_asked_for_is_not_read():
    """Texts are passed over for painted things and operators, and said without places, with the same rows as before; faults stay faults."""
    from quire.sources import content as C

    odd = [
        b"BT /F1 12 Tf [<0041> -500 <0042>] TJ [(x)] TJ [<41>]TJ[<42>]  TJ 3 [1 <43>] TJ [] TJ T* (a) Tj 1 2 (b) \" ET 0 0 m 5 5 l S",
        b"q 2 0 0 2 0 0 cm /P <</MCID 1>> BDC [<41>] TJ [<42>] TJ /Q <</MCID 2>> BDC [<43>] TJ EMC [<44>] TJ EMC [<45>] TJ Q 1 1 2 2 re f",
        b"[<41>] TJx [<4>] TJ [<41> /N] TJ [[<41>]] TJ BI /W 1 ID [<41>] TJ EI [.5 <41> 5. +3] TJ %c\n[<41>] TJ",
    ]
    for data in odd:
        assert [op for op, _ in C.tokens(data)] == [op for op, _ in C.tokens(data, lambda: True)]
        full = list(C.fold(data))
        assert [(e.kind, e.seq, e.state, e.facts, e.marks) for e in C.fold(data, shows="") if e.kind != "text"] == [(e.kind, e.seq, e.state, e.facts, e.marks) for e in full if e.kind != "text"]
        assert [(e.seq, e.facts.get("text"), e.marks) for e in C.fold(data, shows="said")] == [(e.seq, e.facts.get("text"), e.marks) for e in full]
        assert sum(e.kind == "text" for e in C.fold(data, shows="")) < sum(e.kind == "text" for e in full)
    for data in (b"[%s] TJ" % (b"9" * 400), b"[%s] TJ" % (b"9" * 5000)):
        for shows in ("placed", "said", ""):
            with pytest.raises((OverflowError, ValueError)):
                list(C.fold(data, shows=shows))

    def fault(code):
        raise TypeError("no width")

    bad = {"F1": C.Font("F1", width=fault)}
    for shows in ("placed", "said", ""):
        with pytest.raises(TypeError):
            list(C.fold(b"BT /F1 12 Tf [<41>] TJ ET", bad, shows=shows))


def test_marked_like_runs(spark):
    from pyspark.sql import functions as F

    docs = pdfs.made(spark, "/root/testdata/sf0.001").cache()
    at = ("doc_id", "page_idx", "tag", "mcid")
    whole = pdf.runs(docs, "doc_id").groupBy(*at).agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seq)").alias("text"))
    got = pdf.marked(docs, "doc_id").groupBy(*at).agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seq)").alias("text"))
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    docs.unpersist()


def test_a_page_is_folded_by_columns():
    """No row of a page becomes a dictionary, and the numbers are those of whole rows."""

    class Columns:
        def __init__(self, t):
            self.t, self.num_rows = t, t.num_rows

        def __getitem__(self, name):
            return self.t[name]

    class Runs:
        columns = ["doc_id", "page_idx", "seq", "text", "x", "y", "width", "font_size", "space", "bead"]

        def groupBy(self, *_):
            return self

        def applyInArrow(self, fold, _):
            return fold

    rows = [(7, 1, 3, "b", 90, 100.03, 6, 12, 3.0, 1), (7, 1, 1, "a", 72, 100.0, 6, 12, 3.0, 1), (7, 1, 9, None, 72, 80.0, None, 12, None, 1), (7, 1, 2, "first", 72, 50.0, 30, 12, 3.0, 0)]
    page = pa.table(dict(zip(Runs.columns, map(list, zip(*rows)))))
    got = paragraphs.reconstruct(Runs(), factor=0.4, drop=1.0)(Columns(page)).to_pylist()
    assert [(r["seq"], r["ord"], r["line_no"], r["word_break"], r["paragraph"]) for r in got] == [(1, 1, 1, False, "start"), (3, 2, 1, True, None), (9, 3, 2, False, "start"), (2, 4, 3, False, "start")]
    got = paragraphs.reconstruct(Runs(), factor=0.4, drop=1.0, bead="bead")(Columns(page)).to_pylist()
    assert [(r["doc_id"], r["page_idx"], r["seq"], r["ord"], r["line_no"]) for r in got] == [(7, 1, 2, 1, 1), (7, 1, 1, 2, 2), (7, 1, 3, 3, 2), (7, 1, 9, 4, 3)]


def test_runs_without_their_place():
    """The same strings, and the same files are broken."""
    files = [pdfs.build(n, "Some text\n  and more\n" * 30) for n in range(4)]
    files += [files[0].replace(b"/DescendantFonts [4 0 R]", b"/DescendantFonts  555555"), b"", b"%PDF-1.5"]

    def rows(data, **more):
        try:
            return [r[:3] for r in pdf.Rows(lambda d, k: pdf.runs(d, k, **more)).rows(data)]
        except pdf.BROKEN as e:
            return repr(e)

    for data in files:
        assert rows(data, placed=False) == rows(data)
    assert rows(files[4]).startswith("TypeError") and len(rows(files[1])) == 120


def _one_by_one(events):
    for e in events:
        x = e.facts
        if e.kind == "texts":
            for k, seq in enumerate(x["seq"]):
                yield seq, e.state, e.marks, tuple((c, repr(v[k] if isinstance(v, list) else v)) for c, v in sorted(x.items()) if c != "seq")
        elif e.kind != "text" or x["text"]:
            yield e.seq, e.state, e.marks, tuple((c, repr(v)) for c, v in sorted(x.items()) if c != "matrix")


def test_strings_go_through_as_columns(monkeypatch):
    """Strings shown one after another are the same as one by one, to the last bit, and none is asked for by itself in the usual case."""
    from quire.sources import content as C

    rng = random.Random(7)
    texts = {"usual": lambda c: chr(c[1] + 64) if len(c) == 2 else "?", "wide": lambda c: chr(int.from_bytes(c, "big")), "several": lambda c: "ab" * (c[-1] % 3)}
    widths = {"same": lambda c: 500.0, "whole": lambda c: 100.0 * (c[-1] % 5), "broken": lambda c: 0.1 * c[-1]}
    two = lambda d: [d[i : i + 2] for i in range(0, len(d), 2)]
    for n in range(60):
        fonts = lambda: {"A": C.Font("A", two, text, width, True, step=2), "B": C.Font("B")}  # noqa: B023, E731
        text, width = rng.choice(list(texts.values())), rng.choice(list(widths.values()))
        word = lambda: "".join(rng.choice(["0001", "0020", "0007", "4e2d" if n % 4 == 0 else "0009"]) for _ in range(rng.randint(0, 5)))  # noqa: B023, E731
        piece = lambda: rng.choice(["[<%s>] TJ", "[%d <%%s>]TJ" % rng.randint(-900, 900), "[ <%s> 3 <0002>] TJ", "[<%s>] TJ %% note\n", "[(x)] TJ <%s> Tj", "[1.5 <%s>] TJ", "[\0-7\0<%s> ]\0TJ", "4 [<%s0>] TJ"]) % word()
        parts = [rng.choice(["1 0 0 1 72 %d Tm", "2 .5 -1 1 3 %d Tm", "/P <</MCID %d>> BDC", "EMC %d g", "/A %d Tf", "/B %d Tf", "%d Tw 2 Tc 70 Tz", "%d Ts q 2 0 1 2 0 0 cm", "Q T* %d w"]) % rng.randint(0, 20) if rng.random() < 0.3 else piece() for _ in range(60)]
        data = ("BT /A 12 Tf " + " ".join(parts) + " ET 0 0 m 9 9 l S").encode()
        for shows in ("placed", "said"):
            assert list(_one_by_one(C.fold(data, fonts(), shows=shows, many=True))) == list(_one_by_one(C.fold(data, fonts(), shows=shows)))
    assert any(e.kind == "texts" for e in C.fold(data, fonts(), many=True))

    asked = []
    monkeypatch.setattr(C.Font, "string", lambda self, data: asked.append(data))
    for form in range(4):
        rows = list(pdf.Rows(lambda d, k: pdf.runs(d, k, only=("text", "width"))).rows(pdfs.build(form, "Some中 text\n andé  more " * 30)))
        assert len(rows) == 120 and rows[0] == ("Some中", 30.0) and not asked


def test_runs_are_read_with_the_columns_that_a_query_uses(spark):
    """what isn't used isn't sent from Python."""
    got = pdfs.pdf_runs(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "MapInArrow" in line and "mcid" in line)
    assert "fill#" not in sent and "tag#" not in sent and "seq#" not in sent


def test_a_file_is_gone_through_once_for_all_its_parts(monkeypatch):
    """pages and tree don't depend on the part; F6: a row of strings is one event for marked text."""
    file, called, pages = pdfs.build(1, "a b\n" * 2000), [], File.pages
    monkeypatch.setattr(File, "pages", lambda self: called.append(1) or pages(self))
    parts = assemble.split(file, 2)
    assert len(called) == 1 and len(parts) == 51
    assert [p for x in parts for p in shown(x)] == shown(file)
    texts = [e for _, e in pdf.events(File.open(file), "said", True) if e.kind in ("text", "texts")]
    rows = list(pdf.Rows(lambda d, k: pdf.marked(d, k)).rows(file))
    assert len(texts) == len(rows) == 2000 and {r[2] for r in rows} == {"a b"} and {e.kind for e in texts} == {"texts"}


def test_lines_are_written_as_word_by_word():
    """Words by replacement give the same bytes."""
    for line in ("a b", "", " a", "a  b", "é-*a *", "\0\t a", "one", "x " * 40 + "x"):
        letters = sorted(set(line + "q"))
        digits, table = {ord(c): f"{k + 1:04x}" for k, c in enumerate(letters) if c != " "}, pdfs.charmap_build(("￾" + "".join(letters)).ljust(256, "￾"))
        space = f"{letters.index(' ') + 1:02x}" if " " in letters else "*"
        assert pdfs.content([line], digits, 3, (table, space)) == pdfs.content([line], digits, 3)
