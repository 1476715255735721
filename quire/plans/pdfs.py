"""Queries over PDF files that are written from the documents and read back."""

from __future__ import annotations

from codecs import charmap_build, charmap_encode
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.functions import structure as S
from quire.operators import assemble, joins, trees
from quire.session import small_batches, spread, table
from quire.sources import catalog, pdf
from quire.sources import objects as O
from quire.sources.objects import Name, Ref, Stream
from quire.sources.runs import LINES_SQL, ROWS, RUNS_SQL

#: How a document's file is built, by its id modulo 4 (each document has a file; the four forms are alike to a reader):
#: a table of cross-references; object and cross-reference streams; an update behind an older version; lost cross-references.
TABLE, PACKED, UPDATED, DAMAGED = range(4)


def content(lines: list[str], codes: dict[int, str], page: int, table: Any = None) -> bytes:
    """A page: a coloured bar, then each line as marked content, a word a string; spaces are moves of half the size.

    ``codes``: a character's code in hexadecimal digits, by its number, but for spaces.
    ``table``: the second bytes of the codes where the first are zero, as an encoding, and that of a space in digits.
    """
    out = ["q 0.5 0 0 0.5 0 0 cm", f"{page % 2} 0 1 rg 20 {40 + 2 * page} 100 50 re f", "0 0 m 10 0 l 10 20 l s Q", "BT /F1 12 Tf"]
    for i, line in enumerate(lines):
        out.append(f"/P <</MCID {i}>> BDC 1 0 0 1 72 {800 - 14 * i} Tm")
        space = 0
        if table and line and "  " not in line and line[0] != " " != line[-1]:  # all words by three replacements
            digits = charmap_encode(line, "strict", table[0])[0].hex("-")
            out.append("[<00" + digits.replace(f"-{table[1]}-", "*").replace("-", "00").replace("*", ">] TJ\n[-500 <00") + ">] TJ")
            out.append("EMC")
            continue
        for k, word in enumerate(line.translate(codes).split(" ")):
            space += k > 0
            if word:
                out.append(f"[{-500 * space} <{word}>] TJ" if space else f"[<{word}>] TJ")
                space = 0
        out.append("EMC")
    return "\n".join([*out, "ET"]).encode()


def build(doc: int, text: str) -> bytes:
    """The file of a text: 20 lines a page, a composite font whose codes number the text's own characters.

    Beside these a bookmark and a link for each page, a form field, an attachment, page labels and information.
    """
    lines = text.split("\n")
    sheets = [lines[i : i + ROWS] for i in range(0, len(lines), ROWS)]
    letters = sorted(set(text) - {"\n"})
    codes = {c: (k + 1).to_bytes(2, "big") for k, c in enumerate(letters)}
    table = None
    if len(letters) < 256 and "\ufffe" not in letters:
        table = charmap_build(("\ufffe" + "".join(letters)).ljust(256, "\ufffe")), codes[" "][1:].hex() if " " in codes else "*"
    digits = {ord(c): code.hex() for c, code in codes.items() if c != " "}
    rows = [f"<{codes[c].hex()}> <{c.encode('utf-16-be', 'surrogatepass').hex()}>" for c in letters]
    blocks = [f"{len(rows[i:i + 100])} beginbfchar\n" + "\n".join(rows[i : i + 100]) + "\nendbfchar" for i in range(0, len(rows), 100)]
    unicode = "\n".join(["1 begincodespacerange <0000> <ffff> endcodespacerange", *blocks]).encode()
    held = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)},
        2: {"Type": Name("Pages"), "Kids": [Ref(6 + 2 * i) for i in range(len(sheets))], "Count": len(sheets), "MediaBox": [0, 0, 612, 842], "Resources": {"Font": {"F1": Ref(3)}}},
        3: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Own"), "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(4)], "ToUnicode": Ref(5)},
        4: {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Own"), "DW": 1000, "W": [0, len(letters) + 1, 500]},
        5: O.flate(unicode),
    }
    form, pages = doc % 4, len(sheets)
    marks = 6 + 2 * pages  # the root of the bookmarks, then one for each page, a field, information, a file
    field, facts, file = marks + pages + 1, marks + pages + 2, marks + pages + 3
    held[1] |= {"Outlines": Ref(marks), "AcroForm": {"Fields": [Ref(field)]}, "PageLabels": {"Nums": [0, {"S": Name("r")}, 1, {"S": Name("D"), "P": b"p-"}]}, "Names": {"EmbeddedFiles": {"Names": [b"note", {"UF": b"note.txt", "EF": {"UF": Ref(file)}}]}}}
    held[marks] = {"Type": Name("Outlines"), "First": Ref(marks + 1), "Last": Ref(marks + pages)}
    held[field] = {"FT": Name("Tx"), "T": b"id", "V": str(doc).encode(), "Ff": 3}
    held[facts] = {"Title": f"T {doc}".encode(), "Author": b"", "Pages": str(pages).encode()}
    held[file] = O.flate(f"note of {doc}".encode())
    for i, sheet in enumerate(sheets):
        held[marks + 1 + i] = {"Title": b"\xfe\xff" + f"Seite {i}".encode("utf-16-be"), "Parent": Ref(marks), "Dest": [Ref(6 + 2 * i), Name("Fit")]} | ({"Next": Ref(marks + 2 + i)} if i + 1 < pages else {})
        link = {"Subtype": Name("Link"), "Rect": [20, 40, 120, 10], "A": {"S": Name("URI"), "URI": f"http://x.org/{doc}/{i}".encode()}}
        held[6 + 2 * i] = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(7 + 2 * i), "Annots": [link]}
        held[7 + 2 * i] = O.flate(content(sheet, digits, i, table))
    if form == PACKED:
        return O.write(held, 1, packed=50, info=facts)
    if form == UPDATED:
        old = O.write(held | {7: Stream({}, b"BT /F1 12 Tf (old) Tj ET")}, 1, info=facts)
        return O.write({7: held[7]}, 1, before=old, prev=O.last_section(old))
    whole = O.write(held, 1, info=facts)
    return whole[: whole.rindex(b"xref\n0 1")] + b"trailer\n<</Root 1 0 R/Info %d 0 R>>\n" % facts if form == DAMAGED else whole


def made(spark, sf) -> DataFrame:
    """(doc_id, content): the file of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                ids, texts = (c.to_pylist() for c in b.slice(at, 64).columns)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([build(d or 0, t or "") for d, t in zip(ids, texts)], pa.binary())], names=["doc_id", "content"])

    small_batches(spark)
    return spread(table(spark, sf, "documents").select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, content binary")


def kept(docs: DataFrame) -> DataFrame:
    """The files as a written table, for queries that read each of them more than once."""
    at = trees.scratch(docs.sparkSession, "files")
    docs.write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def pdf_documents(spark, sf):
    got = pdf.documents(made(spark, sf), "doc_id")
    return got.select("doc_id", "version", "pages", "recovered", F.array_join("sections", ",").alias("sections"), F.coalesce("error", F.lit("")).alias("error"))


def pdf_objects(spark, sf):
    got = pdf.objects(made(spark, sf), "doc_id").where("type IS NULL OR type NOT IN ('ObjStm', 'XRef')")
    return got.groupBy("doc_id", "kind", "place").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "Page").alias("pages"))


def pdf_references(spark, sf):
    """References resolved to the objects that they name."""
    docs = kept(made(spark, sf))
    edges, held = pdf.references(docs, "doc_id"), pdf.objects(docs, "doc_id").select("doc_id", F.col("num").alias("dst"), "type")
    return edges.where("via NOT IN ('/Root', '/Info')").join(held, ["doc_id", "dst"], "left").groupBy("doc_id", F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def pdf_pages(spark, sf):
    return pdf.pages(made(spark, sf), "doc_id")


def pdf_operators(spark, sf):
    return pdf.operators(made(spark, sf), "doc_id", operands=False).groupBy("doc_id", "op").agg(F.count("*").alias("n"))


def pdf_runs(spark, sf):
    got = pdf.runs(made(spark, sf), "doc_id", only=("page_idx", "mcid", "text", "x", "y", "width", "font_size"))
    return got.select("doc_id", "page_idx", F.col("mcid").alias("line"), "text", *[F.round(c).cast("int").alias(c) for c in ("x", "y", "width", "font_size")])


def pdf_marked_text(spark, sf):
    """A5: the text of each marked-content sequence, by position."""
    got = pdf.marked(made(spark, sf), "doc_id").where("tag = 'P'")
    return got.groupBy("doc_id", "page_idx", "mcid").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seq)").alias("text"))


def pdf_painted(spark, sf):
    got = pdf.painted(made(spark, sf), "doc_id")
    return got.select("doc_id", "page_idx", "what", "rule", "stroked", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")], "fill")


def pdf_chunked_bytes(spark, sf):
    """A file cut into ranges and put together again is the same file."""
    docs = made(spark, sf)
    n = F.octet_length("content")
    parts = docs.select("doc_id", "content", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 1000).cast("int"))).alias("k"))
    parts = parts.select("doc_id", "k", F.expr("substring(content, k * 1000 + 1, 1000)").alias("content"))
    whole = pdf.concatenated(parts, ["doc_id"], "k")
    got = pdf.documents(whole, "doc_id").select("doc_id", "pages")
    return got


def pdf_info(spark, sf):
    return catalog.info(made(spark, sf), "doc_id")


def pdf_bookmarks(spark, sf):
    return catalog.bookmarks(made(spark, sf), "doc_id").select("doc_id", "ord", "depth", "title", "page_idx")


def pdf_links(spark, sf):
    got = catalog.annotations(made(spark, sf), "doc_id").where("subtype = 'Link'")
    return got.select("doc_id", "page_idx", "uri", "x0", "y0", "x1", "y1")


def pdf_fields(spark, sf):
    got = catalog.fields(made(spark, sf), "doc_id")
    return got.select("doc_id", "name", "kind", "value", S.flag(F.col("flags"), "read_only").alias("read_only"), S.flag(F.col("flags"), "multiline").alias("multiline"))


def pdf_attachments(spark, sf):
    return catalog.attachments(made(spark, sf), "doc_id")


def pdf_labels(spark, sf):
    """Each page's label by the ranges in its own file."""
    docs = kept(made(spark, sf))
    starts = catalog.label_ranges(docs, "doc_id")
    got = joins.as_of(pdf.pages(docs, "doc_id").select("doc_id", "page_idx"), starts, ["doc_id"], "page_idx", "start_idx", ["start_idx", "style", "prefix", "first"])
    return got.select("doc_id", "page_idx", scalars.page_label(F.col("style"), F.col("prefix"), F.col("page_idx") - F.col("start_idx") + F.col("first")).alias("label"))


def pdf_merged(spark, sf):
    """Files of fifty ids as one volume, by id: its pages and the words on them."""
    whole = kept(assemble.merge(made(spark, sf).withColumn("volume", F.expr("doc_id DIV 50")), ["volume"], "doc_id"))
    runs = pdf.runs(whole, "volume", only=("width",)).groupBy("volume").agg(F.count("*").alias("words"), F.sum("width").cast("long").alias("width"))
    return pdf.documents(whole, "volume").select("volume", "pages").join(runs, "volume", "left").select("volume", "pages", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("width", F.lit(0)).alias("width"))


def pdf_split(spark, sf):
    """Files of two pages each, and the words on them."""
    parts = kept(assemble.split_every(made(spark, sf), "doc_id", 2).withColumn("k", F.col("doc_id") * (1 << 20) + F.col("chunk")))
    words = pdf.runs(parts, "k", placed=False, only=("page_idx",)).groupBy("k").agg(F.count("*").alias("words"))
    got = pdf.documents(parts, "k").join(words, "k", "left")
    return got.select(F.expr(f"k DIV {1 << 20}").alias("doc_id"), (F.col("k") % (1 << 20)).cast("int").alias("chunk"), "pages", F.coalesce("words", F.lit(0)).alias("words"))


def pdf_decoded(spark, sf):
    """Files with decoded streams: no filter is left, and the pages are the same."""
    plain = kept(assemble.decode_streams(made(spark, sf), "doc_id"))
    left = pdf.objects(plain, "doc_id").groupBy("doc_id").agg(F.sum(F.size("filters")).cast("int").alias("filters"))
    return pdf.documents(plain, "doc_id").join(left, "doc_id").select("doc_id", "pages", "filters")


def broken(docs: DataFrame) -> DataFrame:
    """The files with a font that can't be read in those of every third document, where the font isn't packed."""
    hexed = lambda x: x.encode().hex().upper()
    worse = F.unhex(F.replace(F.hex("content"), F.lit(hexed("/DescendantFonts [4 0 R]")), F.lit(hexed("/DescendantFonts  555555"))))
    return docs.withColumn("content", F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 4 != PACKED), worse).otherwise(F.col("content")))


def pdf_broken(spark, sf):
    """A file that turns out to be broken has an error row in the place of its runs, and never some of them."""
    got = pdf.runs(broken(made(spark, sf)), "doc_id", errors=True, placed=False)
    return got.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("words"), F.count_if(F.col("error").isNotNull()).alias("errors"))


QUERIES = {f.__name__: f for f in (pdf_broken, pdf_merged, pdf_split, pdf_decoded, pdf_info, pdf_bookmarks, pdf_links, pdf_fields, pdf_attachments, pdf_labels, pdf_documents, pdf_objects, pdf_references, pdf_pages, pdf_operators, pdf_runs, pdf_marked_text, pdf_painted, pdf_chunked_bytes)}

_PAGES = f"WITH {LINES_SQL}, p AS (SELECT doc_id, CAST(max(page_no) AS INT) AS pages, count(*) AS lines FROM lines GROUP BY doc_id)"
SQL = {
    "pdf_documents": f"{_PAGES} SELECT doc_id, '1.5' AS version, pages, doc_id % 4 = 3 AS recovered, CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'stream' WHEN 2 THEN 'table,table' ELSE 'scan' END AS sections, '' AS error FROM p",
    "pdf_objects": f"""{_PAGES} SELECT doc_id, 'stream' AS kind, 'at' AS place, pages + 2 AS n, 0 AS pages FROM p
UNION ALL SELECT doc_id, 'dictionary', 'at', 2 * pages + 7, pages FROM p WHERE doc_id % 4 <> 1
UNION ALL SELECT doc_id, 'dictionary', 'at', 1, 0 FROM p WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'dictionary', 'in', 2 * pages + 6, pages FROM p WHERE doc_id % 4 = 1""",
    "pdf_references": f"""{_PAGES} SELECT doc_id, 'Pages' AS type, pages + 1 AS n FROM p UNION ALL SELECT doc_id, 'Page', 2 * pages FROM p UNION ALL SELECT doc_id, 'Font', 2 FROM p
UNION ALL SELECT doc_id, 'Outlines', pages + 1 FROM p UNION ALL SELECT doc_id, 'none', 2 * pages + 4 FROM p""",
    "pdf_merged": f"WITH {RUNS_SQL}, w AS (SELECT doc_id, count(*) AS words, sum(width) AS width FROM runs GROUP BY doc_id), p AS (SELECT doc_id, max(page_no) AS pages FROM lines GROUP BY doc_id) SELECT doc_id // 50 AS volume, CAST(sum(pages) AS INT) AS pages, CAST(coalesce(sum(words), 0) AS BIGINT) AS words, CAST(coalesce(sum(width), 0) AS BIGINT) AS width FROM p LEFT JOIN w USING (doc_id) GROUP BY 1",
    "pdf_split": f"WITH {RUNS_SQL}, c AS (SELECT doc_id, page_idx // 2 AS chunk, count(DISTINCT page_idx) AS pages FROM lines GROUP BY 1, 2), w AS (SELECT doc_id, page_idx // 2 AS chunk, count(*) AS words FROM runs GROUP BY 1, 2) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(pages AS INT) AS pages, coalesce(words, 0) AS words FROM c LEFT JOIN w USING (doc_id, chunk)",
    "pdf_broken": f"WITH {RUNS_SQL}, w AS (SELECT doc_id, count(*) AS words FROM runs GROUP BY doc_id), b AS (SELECT doc_id, doc_id % 3 = 0 AND doc_id % 4 <> 1 AS bad FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN bad THEN 0 ELSE words END AS words, CAST(bad AS BIGINT) AS errors FROM b LEFT JOIN w USING (doc_id) WHERE bad OR words > 0",
    "pdf_decoded": f"{_PAGES} SELECT doc_id, pages, 0 AS filters FROM p",
    "pdf_info": f"{_PAGES} SELECT doc_id, 'Title' AS name, 'T ' || doc_id AS value FROM p UNION ALL SELECT doc_id, 'Pages', CAST(pages AS VARCHAR) FROM p",
    "pdf_bookmarks": f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_idx AS ord, 0 AS depth, 'Seite ' || page_idx AS title, page_idx FROM lines",
    "pdf_links": f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_idx, 'http://x.org/' || doc_id || '/' || page_idx AS uri, 20.0::DOUBLE AS x0, 10.0::DOUBLE AS y0, 120.0::DOUBLE AS x1, 40.0::DOUBLE AS y1 FROM lines",
    "pdf_fields": "SELECT doc_id, 'id' AS name, 'Tx' AS kind, CAST(doc_id AS VARCHAR) AS value, true AS read_only, false AS multiline FROM documents",
    "pdf_attachments": "SELECT doc_id, 'note' AS name, 'note.txt' AS file, CAST(length('note of ' || doc_id) AS BIGINT) AS size, sha256('note of ' || doc_id) AS sha256 FROM documents",
    "pdf_labels": f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_idx, CASE WHEN page_idx = 0 THEN 'i' ELSE 'p-' || page_idx END AS label FROM lines",
    "pdf_pages": f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_idx, 612.0::DOUBLE AS width, 842.0::DOUBLE AS height, 0 AS rotate, 1 AS streams FROM lines",
    "pdf_operators": f"""WITH {RUNS_SQL}, p AS (SELECT doc_id, max(page_no) AS pages, count(*) AS lines FROM lines GROUP BY doc_id), w AS (SELECT doc_id, count(*) AS words FROM runs GROUP BY doc_id),
c AS (SELECT doc_id, op, pages AS n FROM p, (SELECT unnest(['q', 'Q', 'cm', 'rg', 're', 'f', 'm', 's', 'BT', 'ET', 'Tf']) AS op) UNION ALL SELECT doc_id, 'l', 2 * pages FROM p
UNION ALL SELECT doc_id, op, lines FROM p, (SELECT unnest(['BDC', 'EMC', 'Tm']) AS op) UNION ALL SELECT doc_id, 'TJ', words FROM w)
SELECT doc_id, op, CAST(n AS BIGINT) AS n FROM c""",
    "pdf_runs": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, CAST(line_idx % {ROWS} AS INT) AS line, text, x, y, width, font_size FROM runs",
    "pdf_marked_text": f"WITH {RUNS_SQL} SELECT doc_id, page_idx, CAST(line_idx % {ROWS} AS INT) AS mcid, string_agg(text, ' ' ORDER BY word_idx) AS text FROM runs GROUP BY doc_id, page_idx, line_idx",
    "pdf_painted": f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, page_idx FROM lines)
SELECT doc_id, page_idx, 'mlllh' AS what, 'nonzero' AS rule, false AS stroked, 10.0::DOUBLE AS x0, (20 + page_idx)::DOUBLE AS y0, 60.0::DOUBLE AS x1, (45 + page_idx)::DOUBLE AS y1, 'DeviceRGB ' || page_idx % 2 || ' 0 1' AS fill FROM p
UNION ALL SELECT doc_id, page_idx, 'mllh', '', true, 0, 0, 5, 10, 'DeviceRGB ' || page_idx % 2 || ' 0 1' FROM p""",
    "pdf_chunked_bytes": f"{_PAGES} SELECT doc_id, pages FROM p",
}
