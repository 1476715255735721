"""PDF bytes as relations: files, objects, cross-references, pages, operators, text runs, painted things.

Each relation is one pass of a Python function over batches of (id, content); a file never
meets another one, so nothing is shuffled. A file that can't be read to its end gives no
rows, or with ``errors`` one that says why.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import cmaps
from quire.session import small_batches
from quire.sources import content
from quire.sources.objects import File, Name, Ref, Stream, Word, dump

#: What a broken file may raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError, RecursionError, zlib.error)
#: Rows of an outgoing batch.
ROWS = 8192


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


class Rows:
    """In the place of a DataFrame: takes a relation's schema and row function instead of running them."""

    def __init__(self, relation: Callable[..., Any]):
        relation(self, "path")


def flat(docs: DataFrame, key: str, schema: str, rows: Callable[[bytes], Iterator[tuple]], errors: bool = False, blocks: bool = False) -> DataFrame:
    """The key of each (key, content) with the rows of its content; null content has none.

    A file gives all of its rows or none: one that turns out to be broken on the way gives
    none, or with ``errors`` a single row of nulls that says why in a further column
    ``error``, which is null in all others. A file's rows are held until it is through.
    ``blocks``: the function gives several rows at a time, as their number and a list or
    a value common to all for each column.
    """
    if isinstance(docs, Rows):
        docs.schema, docs.rows = schema, _each(rows) if blocks else rows
        return docs
    kinds = T._parse_datatype_string(schema).fields
    out = T.StructType([docs.schema[key], *kinds, *([T.StructField("error", T.StringType())] if errors else [])])
    arrow = to_arrow_schema(out)

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in arrow]
        for b in batches:
            for k, data in zip(b.column(0), b.column(1)):
                k, data = k.as_py(), data.as_py()
                if data is None:
                    continue
                whole = len(held[0])
                try:
                    for n, block in rows(data):
                        for column, v in zip(held, (k, *block, None)):
                            column.extend(v if type(v) is list else repeat(v, n))
                except BROKEN as e:
                    for column in held:
                        del column[whole:]
                    if errors:
                        for column, v in zip(held, (k, *[None] * len(kinds), f"{type(e).__name__}: {e}"[:200])):
                            column.append(v)
                if len(held[0]) >= ROWS:
                    for at in range(0, len(held[0]), ROWS):
                        yield _columns([c[at : at + ROWS] for c in held], arrow)
                    held = [[] for _ in arrow]
        if held[0]:
            yield _columns(held, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for k, data in zip(b.column(0), b.column(1)):  # a file at a time: a batch may hold all that a task reads
                k, data = k.as_py(), data.as_py()
                if data is None:
                    continue
                whole = len(held)
                try:
                    held.extend((k, *r, None) if errors else (k, *r) for r in rows(data))
                except BROKEN as e:
                    del held[whole:]
                    if errors:
                        held.append((k, *[None] * len(kinds), f"{type(e).__name__}: {e}"[:200]))
                for at in range(0, len(held) - ROWS + 1, ROWS):
                    yield _batch(held[at : at + ROWS], arrow)
                del held[: len(held) // ROWS * ROWS]
        if held:
            yield _batch(held, arrow)

    small_batches(docs.sparkSession)
    return docs.select(key, "content").mapInArrow(run_blocks if blocks else run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return _columns(list(zip(*rows)), schema)


def _columns(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _each(blocks: Callable[[bytes], Iterator[tuple[int, tuple]]]) -> Callable[[bytes], Iterator[tuple]]:
    """The rows of blocks, one by one."""

    def rows(data: bytes) -> Iterator[tuple]:
        for n, block in blocks(data):
            yield from zip(*[v if type(v) is list else repeat(v, n) for v in block])

    return rows


def documents(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, version, pages, objects, recovered, sections, error): one row a file."""

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            f = File.open(data)
            yield f.version, len(f.pages()), len(f.where), f.recovered, [k for k, _ in f.sections], None
        except BROKEN as e:
            yield None, None, None, None, None, type(e).__name__

    return flat(docs, key, "version string, pages int, objects int, recovered boolean, sections array<string>, error string", rows)


def _kind(v: Any) -> str:
    return next((n for t, n in ((Stream, "stream"), (dict, "dictionary"), (list, "array"), (Name, "name"), (bytes, "string"), (bool, "boolean"), (Word, "word"), ((int, float), "number")) if isinstance(v, t)), "null")


def objects(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, num, place, at, idx, kind, type, filters, value): one row an object.

    ``place``: "at" an offset of the file or "in" an object stream, whose number ``at``
    is, as its ``idx``-th. ``value`` is the object in a file's syntax, a stream's head.
    """

    def rows(data: bytes) -> Iterator[tuple]:
        for n, place, at, idx, v in File.open(data).objects():
            head = v.head if isinstance(v, Stream) else v
            kind = head.get("Type") if isinstance(head, dict) else None
            yield n, place, at, idx, _kind(v), str(kind) if isinstance(kind, Name) else None, v.chain()[0] if isinstance(v, Stream) else [], dump(head).decode("latin-1")

    return flat(docs, key, "num long, place string, at long, idx int, kind string, type string, filters array<string>, value string", rows, errors)


def references(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, src, dst, via): every reference inside an object, by the keys that lead to it."""

    def walk(v: Any, via: str) -> Iterator[tuple[int, str]]:
        if isinstance(v, Ref):
            yield v.num, via
        elif isinstance(v, (dict, Stream)):
            for k, x in (v.head if isinstance(v, Stream) else v).items():
                yield from walk(x, f"{via}/{k}")
        elif isinstance(v, list):
            for x in v:
                yield from walk(x, f"{via}[]")

    def rows(data: bytes) -> Iterator[tuple]:
        for n, _, _, _, v in File.open(data).objects():
            for dst, via in walk(v, ""):
                yield n, dst, via

    return flat(docs, key, "src long, dst long, via string", rows, errors)


def pages(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, page_idx, width, height, rotate, streams) with what a page inherits."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for i, p in enumerate(f.pages()):
            box = [float(x) for x in f.get(p.get("CropBox") or p.get("MediaBox")) or (0, 0, 612, 792)]
            parts = f.get(p.get("Contents"))
            yield i, abs(box[2] - box[0]), abs(box[3] - box[1]), int(f.get(p.get("Rotate")) or 0) % 360, len(parts) if isinstance(parts, list) else int(parts is not None)

    return flat(docs, key, "page_idx int, width double, height double, rotate int, streams int", rows, errors)


def stretches(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """``operators``, with ``n``: those ``TJ`` that follow each other may be one row, at the first one's place, that counts them. Their operands aren't read (null)."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for i, p in enumerate(f.pages()):
            seq = 0
            for op, args in content.tokens(f.content(p), lambda: True, True):
                n = 1 if op else len(args)
                yield i, seq, op or "TJ", content.spelled(args) if op and op != "TJ" else None, n
                seq += n

    return flat(docs, key, "page_idx int, seq int, op string, operands string, n int", rows, errors)


def operators(docs: DataFrame, key: str = "path", errors: bool = False, operands: bool = True) -> DataFrame:
    """(key, page_idx, seq, op, operands) of every page's content; without ``operands`` these aren't read."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for i, p in enumerate(f.pages()):
            for seq, (op, args) in enumerate(content.tokens(f.content(p), None if operands else lambda: True)):
                yield (i, seq, op, content.spelled(args)) if operands else (i, seq, op)

    return flat(docs, key, "page_idx int, seq int, op string" + ", operands string" * operands, rows, errors)


def font(f: File, name: str, v: Any) -> content.Font:
    """Codes, text and widths of a font dictionary: composite with an identity or own CMap, or simple by its encoding."""
    head = f.get(v)
    if not isinstance(head, dict):
        return content.Font(name, total=True)
    unicode = f.get(head.get("ToUnicode"))
    cmap = cmaps.parse(unicode.data()) if isinstance(unicode, Stream) else None
    if head.get("Subtype") == "Type0":
        below = f.get((f.get(head.get("DescendantFonts")) or [None])[0]) or {}
        enc = f.get(head.get("Encoding"))
        own = cmaps.parse(enc.data()) if isinstance(enc, Stream) else None
        widths, w = {}, f.get(below.get("W")) or []
        i = 0
        while i + 1 < len(w):
            nxt = f.get(w[i + 1])
            if isinstance(nxt, list):
                widths |= {w[i] + k: float(x) for k, x in enumerate(nxt)}
                i += 2
            else:
                widths |= {c: float(w[i + 2]) for c in range(w[i], nxt + 1)} if i + 2 < len(w) else {}
                i += 3
        usual = float(below.get("DW", 1000))

        def cid(code: bytes) -> int:
            return own.cid(code) if own else int.from_bytes(code, "big")

        apart = own is not None and bool(own.spaces)
        cut = own.codes if apart else lambda data: [data[i : i + 2] for i in range(0, len(data), 2)]
        return content.Font(name, cut, (cmap.text if cmap else lambda c: c.decode("utf-16-be", "replace")), lambda c: widths.get(cid(c), usual), own is None, step=0 if apart else 2)
    enc = f.get(head.get("Encoding"))
    base = enc if isinstance(enc, Name) else enc.get("BaseEncoding", "StandardEncoding") if isinstance(enc, dict) else "StandardEncoding"
    table = dict(cmaps.encoding(base)) if base in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding") else dict(cmaps.encoding("StandardEncoding"))
    code = 0
    for x in (f.get(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
        if isinstance(x, int):
            code = x
        else:
            table[code] = cmaps.glyph_text(str(x)) or table.get(code, "")
            code += 1
    first, widths = int(f.get(head.get("FirstChar")) or 0), f.get(head.get("Widths")) or []
    missing = float((f.get(head.get("FontDescriptor")) or {}).get("MissingWidth", 500 if not widths else 0))

    def text(c: bytes) -> str | None:
        return (cmap.text(c) if cmap else None) or table.get(c[0])

    def width(c: bytes) -> float:
        k = c[0] - first
        return float(f.get(widths[k])) if 0 <= k < len(widths) else missing

    return content.Font(name, lambda data: [data[i : i + 1] for i in range(len(data))], text, width)


def events(f: File, shows: str = "placed", many: bool = False) -> Iterator[tuple[int, content.Event]]:
    """(page, event) of every page, with its fonts and property lists; a font is read once for the file."""
    known: dict[Any, content.Font] = {}
    for i, p in enumerate(f.pages()):
        res = f.get(p.get("Resources")) or {}
        fonts = {}
        for name, v in (f.get(res.get("Font")) or {}).items():
            at = v if isinstance(v, Ref) else (i, name)
            if at not in known:
                known[at] = font(f, name, v)
            fonts[name] = known[at]
        lists = {k: f.get(v) for k, v in (f.get(res.get("Properties")) or {}).items()}
        for e in content.fold(f.content(p), fonts, {k: v for k, v in lists.items() if isinstance(v, dict)}, shows, many):
            yield i, e


#: The columns of ``runs`` behind the key.
RUN = {"page_idx": "int", "seq": "int", "text": "string", "x": "double", "y": "double", "width": "double", "font_size": "double", "font": "string", "fill": "string", "mode": "int", "tag": "string", "mcid": "int"}


def runs(docs: DataFrame, key: str = "path", errors: bool = False, placed: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """(key, page_idx, seq, text, x, y, width, font_size, font, fill, mode, tag, mcid) of every string that shows text.

    Without ``placed`` only up to the text, or the columns in ``only``. Strings shown one
    after another go through together, as columns.
    """
    chosen = only or (tuple(RUN) if placed else tuple(RUN)[:3])

    def blocks(data: bytes) -> Iterator[tuple[int, tuple]]:
        for i, e in events(File.open(data), "placed" if placed else "said", True):
            x = e.facts
            if e.kind == "texts" or e.kind == "text" and x["text"]:
                tag, mcid, _ = e.marks[-1] if e.marks else (None, None, None)
                have = {"page_idx": i, "seq": e.seq, "fill": _colour(e.state.fill), "mode": e.state.mode, "tag": tag, "mcid": mcid if isinstance(mcid, int) else None, **x}
                yield len(x["text"]) if e.kind == "texts" else 1, tuple([have[c] for c in chosen])

    return flat(docs, key, ", ".join(f"{c} {RUN[c]}" for c in chosen), blocks, errors, True)


def marked(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, page_idx, seq, text, tag, mcid): the strings that follow each other in the same marked content, joined by a space."""

    def rows(data: bytes) -> Iterator[tuple]:
        at, first, texts = None, 0, []
        for i, e in events(File.open(data), "said", True):
            if e.kind == "texts" or e.kind == "text" and e.facts["text"]:
                tag, mcid, _ = e.marks[-1] if e.marks else (None, None, None)
                here = i, tag, mcid if isinstance(mcid, int) else None
                several = e.kind == "texts"
                if here != at:
                    if texts:
                        yield at[0], first, " ".join(texts), at[1], at[2]
                    at, first, texts = here, e.facts["seq"][0] if several else e.seq, []
                texts += e.facts["text"] if several else [e.facts["text"]]
        if texts:
            yield at[0], first, " ".join(texts), at[1], at[2]

    return flat(docs, key, "page_idx int, seq int, text string, tag string, mcid int", rows, errors)


@lru_cache(1024)
def _colour(c: tuple) -> str:
    return " ".join(x if isinstance(x, str) else f"{x:g}" for x in c)


def painted(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, page_idx, seq, kind, what, rule, stroked, x0, y0, x1, y1, fill, stroke, line) of paths, images, objects and shadings."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, e in events(File.open(data), ""):
            if e.kind in ("path", "image", "object", "shading"):
                box = e.facts.get("box") or [None] * 4
                yield i, e.seq, e.kind, e.facts.get("segments") or e.facts.get("name") or "", e.facts.get("rule", ""), e.facts.get("stroked", False), *map(lambda v: None if v is None else float(v), box), _colour(e.state.fill), _colour(e.state.stroke), float(e.state.line)

    return flat(docs, key, "page_idx int, seq int, kind string, what string, rule string, stroked boolean, x0 double, y0 double, x1 double, y1 double, fill string, stroke string, line double", rows, errors)


def sections(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, ord, kind, at): the cross-reference sections from the newest on."""

    def rows(data: bytes) -> Iterator[tuple]:
        for k, (kind, at) in enumerate(File.open(data).sections):
            yield k, kind, at

    return flat(docs, key, "ord int, kind string, at long", rows, errors)


def linearization(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, version, length, first_page, pages) of the files whose first object says that they are linearized."""

    def rows(data: bytes) -> Iterator[tuple]:
        from quire.sources.objects import Parser

        m = re.search(rb"\d+\s+\d+\s+obj", data[:2048])
        got = Parser(data, m.start()).indirect() if m else None
        if got and isinstance(got[2], dict) and "Linearized" in got[2]:
            d = got[2]
            yield float(d["Linearized"]), d.get("L"), d.get("O"), d.get("N")

    return flat(docs, key, "version double, length long, first_page long, pages int", rows, errors)


def sub_range(docs: DataFrame, start: int, length: int) -> DataFrame:
    """The content's bytes from an offset on; a range beyond the end is cut, one behind it empty."""
    if start < 0 or length < 0:
        raise ValueError("a range can't be negative")
    return docs.withColumn("content", F.substring("content", start + 1, length))


def concatenated(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, content): the parts of each key, one after another in order; null parts are empty."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content").alias("c"))))
    # one join of all digits: a fold that appends copies what it has for every part
    whole = F.array_join(F.transform(rows, lambda r: F.coalesce(F.hex(r["c"]), F.lit(""))), "")
    return parts.groupBy(*keys).agg(F.unhex(whole).alias("content"))
