"""What hangs below a file's catalog, as relations: information, bookmarks, annotations, fields, labels, attachments, structure, signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from quire.sources.objects import File, Name, Ref, Stream
from quire.sources.pdf import flat


def text(v: Any) -> str | None:
    """A text string: UTF-16 or UTF-8 by its mark, else a byte a character."""
    if isinstance(v, bytes):
        for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
            if v.startswith(mark):
                return v[len(mark) :].decode(code, "replace")
        return v.decode("latin-1")
    return None if v is None else str(v)


def root(f: File) -> dict:
    v = f.get(f.trailer.get("Root"))
    return v if isinstance(v, dict) else {}


def tree(f: File, node: Any, leaf: str, seen: frozenset = frozenset()) -> Iterator[tuple[Any, Any]]:
    """The pairs of a name or number tree in order; a node is visited once on its way down."""
    if isinstance(node, Ref):
        if node.num in seen:
            return
        seen = seen | {node.num}
    held = f.get(node)
    if not isinstance(held, dict):
        return
    pairs = f.get(held.get(leaf)) or []
    yield from zip(pairs[0::2], pairs[1::2])
    for kid in f.get(held.get("Kids")) or []:
        yield from tree(f, kid, leaf, seen)


def _numbers(f: File) -> dict[int, int]:
    """Object number -> index of the pages, through the page tree's references."""
    out: dict[int, int] = {}

    def walk(v: Any, seen: frozenset) -> None:
        node = f.get(v)
        if not isinstance(node, dict) or (isinstance(v, Ref) and v.num in seen):
            return
        if isinstance(f.get(node.get("Kids")), list):
            for kid in f.get(node["Kids"]):
                walk(kid, seen | ({v.num} if isinstance(v, Ref) else set()))
        else:
            out[v.num if isinstance(v, Ref) else -1 - len(out)] = len(out)

    walk(root(f).get("Pages"), frozenset())
    return out


def destinations(f: File) -> dict[str, Any]:
    """Named destinations, from the name tree and the old dictionary."""
    out = {str(k): v for k, v in (f.get(root(f).get("Dests")) or {}).items()}
    names = f.get(root(f).get("Names")) or {}
    return out | {text(k): v for k, v in tree(f, names.get("Dests"), "Names")}


def page_of(f: File, v: Any, numbers: dict[int, int], named: dict[str, Any]) -> int | None:
    """The page of a destination, a name of one, or a dictionary with one."""
    for _ in range(4):  # an action holds a name, which stands for a dictionary with the destination
        v = f.get(v)
        if isinstance(v, (bytes, Name)):
            v = named.get(text(v))
        elif isinstance(v, dict):
            v = v.get("D")
        else:
            break
    if isinstance(v, list) and v:
        return numbers.get(v[0].num) if isinstance(v[0], Ref) else v[0] if isinstance(v[0], int) else None
    return None


def info(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, name, value) of the information dictionary, names in order, empty values left out."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for k, v in sorted((f.get(f.trailer.get("Info")) or {}).items()):
            if value := text(f.get(v)):
                yield k, value

    return flat(docs, key, "name string, value string", rows, errors)


def bookmarks(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, ord, depth, title, page_idx): a bookmark's own destination counts before its action's."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        numbers, named, seen, n = _numbers(f), destinations(f), set(), 0
        stack = [((f.get(root(f).get("Outlines")) or {}).get("First"), 0)]
        while stack:
            ref, depth = stack.pop()
            node = f.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.num in seen):
                continue
            seen |= {ref.num} if isinstance(ref, Ref) else set()
            at = page_of(f, node.get("Dest"), numbers, named)
            action = f.get(node.get("A"))
            yield n, depth, text(f.get(node.get("Title"))), at if at is not None else page_of(f, action, numbers, named) if isinstance(action, dict) else None
            n += 1
            stack += [(node.get("Next"), depth), (node.get("First"), depth + 1)]

    return flat(docs, key, "ord int, depth int, title string, page_idx int", rows, errors)


def annotations(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, page_idx, idx, subtype, x0, y0, x1, y1, uri, to_page, contents, flags)."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        numbers, named = _numbers(f), destinations(f)
        for i, p in enumerate(f.pages()):
            for k, ref in enumerate(f.get(p.get("Annots")) or []):
                a = f.get(ref)
                if not isinstance(a, dict):
                    continue
                act = f.get(a.get("A")) or {}
                box = [float(f.get(x)) for x in f.get(a.get("Rect")) or ()]
                box = [min(box[0::2]), min(box[1::2]), max(box[0::2]), max(box[1::2])] if len(box) == 4 else [None] * 4
                yield i, k, text(a.get("Subtype")), *box, text(f.get(act.get("URI"))), page_of(f, a.get("Dest") or act.get("D"), numbers, named), text(f.get(a.get("Contents"))), int(f.get(a.get("F")) or 0)

    return flat(docs, key, "page_idx int, idx int, subtype string, x0 double, y0 double, x1 double, y1 double, uri string, to_page int, contents string, flags int", rows, errors)


def fields(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, name, kind, flags, value, terminal): form fields by their qualified names, with what they inherit."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)

        def walk(refs: Any, above: str, have: dict, seen: frozenset) -> Iterator[tuple]:
            for ref in f.get(refs) or []:
                node = f.get(ref)
                if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.num in seen):
                    continue
                own = have | {k: node[k] for k in ("FT", "Ff", "V") if k in node}
                name = ".".join(x for x in (above, text(f.get(node.get("T")))) if x)
                kids = [k for k in f.get(node.get("Kids")) or [] if isinstance(f.get(k), dict) and "T" in f.get(k)]
                if "T" in node:
                    yield name, text(f.get(own.get("FT"))), int(f.get(own.get("Ff")) or 0), text(f.get(own.get("V"))), not kids
                yield from walk(kids, name, own, seen | ({ref.num} if isinstance(ref, Ref) else set()))

        yield from walk((f.get(root(f).get("AcroForm")) or {}).get("Fields"), "", {}, frozenset())

    return flat(docs, key, "name string, kind string, flags int, value string, terminal boolean", rows, errors)


def label_ranges(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, start_idx, style, prefix, first) of the page labels; ``layout``'s as-of join gives each page its own."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for start, v in tree(f, root(f).get("PageLabels"), "Nums"):
            v = f.get(v) or {}
            yield int(start), text(f.get(v.get("S"))), text(f.get(v.get("P"))), int(f.get(v.get("St")) or 1)

    return flat(docs, key, "start_idx int, style string, prefix string, first int", rows, errors)


def attachments(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, name, file, size, sha256) of embedded files."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for name, v in tree(f, (f.get(root(f).get("Names")) or {}).get("EmbeddedFiles"), "Names"):
            spec = f.get(v) or {}
            ef = f.get(spec.get("EF")) or {}
            s = f.get(ef.get("UF") or ef.get("F"))
            if isinstance(s, Stream):
                yield text(name), text(f.get(spec.get("UF") or spec.get("F"))), len(s.data()), hashlib.sha256(s.data()).hexdigest()

    return flat(docs, key, "name string, file string, size long, sha256 string", rows, errors)


def structure(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, ord, parent, depth, role, standard, page_idx, mcid, alt): structure elements and the marked content below them.

    Marked content has no role. A role is followed through the role map until it is in it no more.
    """

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        numbers, top = _numbers(f), f.get(root(f).get("StructTreeRoot")) or {}
        roles = {str(k): text(v) for k, v in (f.get(top.get("RoleMap")) or {}).items()}
        stack, n, seen = [(k, None, 0, None) for k in reversed(_list(f, top.get("K")))], 0, set()
        while stack:
            v, parent, depth, page = stack.pop()
            node = f.get(v)
            if isinstance(v, Ref):
                if v.num in seen:
                    continue
                seen.add(v.num)
            if isinstance(node, int):
                yield n, parent, depth, None, None, page, node, None
            elif isinstance(node, dict):
                pg = node.get("Pg")
                page = numbers.get(pg.num, page) if isinstance(pg, Ref) else page
                if "S" not in node:
                    yield n, parent, depth, None, None, page, node.get("MCID"), None
                else:
                    role, met = text(node["S"]), set()
                    standard = role
                    while standard in roles and standard not in met:
                        met.add(standard)
                        standard = roles[standard]
                    yield n, parent, depth, role, standard, page, None, text(f.get(node.get("Alt")))
                    stack += [(k, n, depth + 1, page) for k in reversed(_list(f, node.get("K")))]
            else:
                continue
            n += 1

    return flat(docs, key, "ord int, parent int, depth int, role string, standard string, page_idx int, mcid int, alt string", rows, errors)


def _list(f: File, v: Any) -> list:
    held = f.get(v)
    return held if isinstance(held, list) else [] if held is None else [v]


def signatures(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, name, filter, sub_filter, covered, sha256): the digest of the bytes that a signature's ranges cover."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        for _, _, _, _, v in f.objects():
            s = f.get(v.get("V")) if isinstance(v, dict) and v.get("FT") == "Sig" else None
            if isinstance(s, dict) and isinstance(f.get(s.get("ByteRange")), list):
                r = f.get(s["ByteRange"])
                held = b"".join(data[a : a + n] for a, n in zip(r[0::2], r[1::2]))
                yield text(f.get(v.get("T"))), text(s.get("Filter")), text(s.get("SubFilter")), len(held), hashlib.sha256(held).hexdigest()

    return flat(docs, key, "name string, filter string, sub_filter string, covered long, sha256 string", rows, errors)


def packets(docs: DataFrame, key: str = "path", errors: bool = False) -> DataFrame:
    """(key, content): each file's own metadata packet, for ``structure.xmp``."""

    def rows(data: bytes) -> Iterator[tuple]:
        f = File.open(data)
        s = f.get(root(f).get("Metadata"))
        if isinstance(s, Stream):
            yield (s.data(),)

    return flat(docs, key, "content binary", rows, errors)
