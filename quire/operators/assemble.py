"""Whole files made of whole files: merged, split, rewritten with decoded streams; each is one object graph renumbered."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions import codecs
from quire.sources import objects as O
from quire.sources.objects import File, Name, Ref, Stream
from quire.sources.pdf import BROKEN, flat

#: Filters whose data is an image's own and stays encoded (fixed values).
IMAGE_FILTERS = frozenset(("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode"))


def renumbered(v: Any, to: dict[int, int]) -> Any:
    """A value with its references under other numbers; what isn't mapped becomes null."""
    if isinstance(v, Ref):
        return Ref(to[v.num]) if v.num in to else None
    if isinstance(v, list):
        return [renumbered(x, to) for x in v]
    if isinstance(v, dict):
        return {k: renumbered(x, to) for k, x in v.items()}
    if isinstance(v, Stream):
        return Stream(renumbered(v.head, to), v.raw)
    return v


def reached(f: File, start: list[Any], stop: set[int]) -> list[int]:
    """The numbers of the objects that the values reach, not through those of ``stop``; each once, so cycles end."""
    out, seen, stack = [], set(stop), list(reversed(start))
    while stack:
        v = stack.pop()
        if isinstance(v, Ref):
            if v.num in seen:
                continue
            seen.add(v.num)
            if v.num not in f.where:
                continue
            out.append(v.num)
            v = f.get(v)
        if isinstance(v, Stream):
            v = v.head
        if isinstance(v, (dict, list)):
            stack += reversed(list(v.values() if isinstance(v, dict) else v))
    return out


def _tree(f: File) -> tuple[list[dict], set[int]]:
    """A file's pages, and the numbers of the objects that make up its page tree."""
    return f.pages(), {n for n in f.where if isinstance(v := f.get(Ref(n)), dict) and v.get("Type") in ("Pages", "Page", "Catalog")}


def _cut(f: File, pages: list[dict], tree: set[int], chosen: range, first: int) -> tuple[dict[int, Any], list[Ref]]:
    """Objects of the chosen pages under numbers from ``first``, and references to the pages; the parent is to be set."""
    held: dict[int, Any] = {}
    refs, to = [], {}
    starts = [{k: v for k, v in pages[i].items() if k != "Parent"} for i in chosen]
    for n in reached(f, starts, tree):
        to[n] = first + len(to)
    for n, new in to.items():
        held[new] = renumbered(f.get(Ref(n)), to)
    at = first + len(to)
    for page in starts:
        held[at] = renumbered(page, to) | {"Type": Name("Page")}
        refs.append(Ref(at))
        at += 1
    return held, refs


def _file(parts: list[tuple[dict[int, Any], list[Ref]]]) -> bytes:
    held: dict[int, Any] = {}
    kids: list[Ref] = []
    for objects, refs in parts:
        held |= objects
        kids += refs
    for r in kids:
        held[r.num]["Parent"] = Ref(2)
    held |= {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}}
    return O.write(held, 1)


def merged(files: list[bytes]) -> bytes:
    """One file with the pages of all, in order; objects that no page needs stay behind. A file that can't be read has no pages."""
    parts, first = [], 3
    for data in files:
        try:
            f = File.open(data)
            pages, tree = _tree(f)
            held, refs = _cut(f, pages, tree, range(len(pages)), first)
        except BROKEN:
            continue
        parts.append((held, refs))
        first += len(held)
    return _file(parts)


def split(data: bytes, size: int, start: int = 1, end: int | None = None) -> list[bytes]:
    """Files of ``size`` pages each, from page ``start`` to ``end`` (from 1, the last may be shorter). Bad bounds raise."""
    if size < 1 or start < 1 or (end is not None and end < start):
        raise ValueError("size and start must be positive and end not before start")
    f = File.open(data)
    pages, tree = _tree(f)  # once: a file may be cut into as many parts as it has pages
    last = min(len(pages), end or len(pages))
    return [_file([_cut(f, pages, tree, range(a, min(a + size, last)), 3)]) for a in range(start - 1, last, size)]


def decoded(data: bytes) -> bytes:
    """The file with every stream's filters undone, but for images' own; object streams become plain objects."""
    f, held = File.open(data), {}
    for n, _, _, _, v in f.objects():
        if isinstance(v, Stream):
            if v.head.get("Type") in ("ObjStm", "XRef"):
                continue
            names, params = v.chain()
            keep = next((k for k, x in enumerate(names) if x in IMAGE_FILTERS or x not in codecs.FILTERS), len(names))
            head = {k: x for k, x in v.head.items() if k not in ("Filter", "DecodeParms", "Length")}
            if keep < len(names):
                head |= {"Filter": [Name(x) for x in names[keep:]], "DecodeParms": [p or None for p in params[keep : len(names)]]}
            v = Stream(head, codecs.decode(v.raw, names[:keep], params))
        held[n] = v
    top = f.trailer.get("Root")
    return O.write(held, top.num, info=f.trailer["Info"].num if isinstance(f.trailer.get("Info"), Ref) else None)


def merge(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, content): the files of each key as one, in order. A key's files meet in one task, as they become one file; a key should have as many as a file may hold."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r[order] is None, r[order]))
        return pa.table([pa.array([rows[0][k]], group.schema.field(k).type) for k in keys] + [pa.array([merged([r["content"] for r in rows if r["content"] is not None])], pa.binary())], names=[*keys, "content"])

    schema = docs.select(*keys, "content").schema
    return docs.select(*dict.fromkeys([*keys, order, "content"])).groupBy(*keys).applyInArrow(run, schema)


def split_every(docs: DataFrame, key: str, size: int, start: int = 1, end: int | None = None) -> DataFrame:
    """(key, chunk, content): each file's pages in files of ``size``."""
    if size < 1 or start < 1 or (end is not None and end < start):
        raise ValueError("size and start must be positive and end not before start")
    return flat(docs, key, "chunk int, content binary", lambda data: enumerate(split(data, size, start, end)))


def decode_streams(docs: DataFrame, key: str) -> DataFrame:
    return flat(docs, key, "content binary", lambda data: iter([(decoded(data),)]))
