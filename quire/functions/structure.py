"""Rules on fonts, fields, encryption, metadata and forms, as expressions or small functions."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import codecs
from quire.functions.scalars import escape_html
from quire.sources import pdf
from quire.sources.objects import File, Ref

#: Bits of a form field's flags, from 1 (fixed values).
FIELD_FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_to_off": 15, "radio": 16, "push_button": 17, "combo": 18, "edit": 19, "sort": 20, "file_select": 21, "multi_select": 22, "do_not_spell_check": 23, "do_not_scroll": 24, "comb": 25, "in_unison": 26, "commit_on_change": 27}
#: Levels of conformance that an archive or access claim may name (fixed values).
CONFORMANCE = ("A", "B", "U", "e", "f")


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(1 << (FIELD_FLAGS[name] - 1)) != 0


def options(entries: Column, which: int) -> Column:
    """The export (0) or display (1) values of choice options: one-element entries stand for both, others than one or two go."""
    good = F.filter(entries, lambda o: F.size(o).isin(1, 2))
    return F.transform(good, lambda o: F.when(F.size(o) == 1, o[0]).otherwise(o[which]))


def font_height(bbox: Column, cap: Column, ascent: Column, descent: Column) -> Column:
    """Half the box's height, unless the capitals' height or, where that exceeds the ascent, half
    the span of ascent and descent is lower; in units of the size."""
    half = bbox / 2
    h = F.when((cap != 0) & ((cap < half) | (half == 0)), cap).otherwise(half)
    span = (ascent - descent) / 2
    h = F.when((cap > ascent) & (ascent > 0) & (descent < 0) & ((span < h) | (h == 0)), span).otherwise(h)
    return h / 1000


def bold(font: Column, forced: Column) -> Column:
    return F.coalesce(forced, F.lit(False)) | F.lower(font).contains("bold")


def italic(font: Column, flagged: Column) -> Column:
    low = F.lower(font)
    return F.coalesce(flagged, F.lit(False)) | low.contains("italic") | low.contains("oblique")


def measure(value: Column, steps: list[tuple[str, float]], places: int = 0) -> Column:
    """A number in units, each so many of the next: whole numbers of all but the last, which is rounded."""
    out, rest = [], value
    for k, (label, factor) in enumerate(steps):
        rest = rest * factor
        whole = F.round(rest, places) if k == len(steps) - 1 else F.floor(rest)
        out.append(F.concat((F.format_number(whole, places) if places and k == len(steps) - 1 else whole.cast("bigint").cast("string")), F.lit(" " + label)))
        rest = rest - F.floor(rest)
    return F.concat_ws(" ", *out)


def alternatives(rows: DataFrame, key: str, lang: str, value: str, order: str) -> DataFrame:
    """(key, langs): for each key its values by language, the last of each, ``x-default`` first."""
    last = rows.groupBy(key, lang).agg(F.max_by(value, order).alias("_v"))
    item = F.struct((F.col(lang) != "x-default").alias("a"), F.col(lang).alias("l"), F.col("_v").alias("v"))
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["l"], F.lit("="), x["v"])).alias("langs"))


# metadata packets -----------------------------------------------------------------------

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_XML = "{http://www.w3.org/XML/1998/namespace}lang"


def xmp_rows(packet: bytes) -> Iterator[tuple[str, str, str, int, str | None, str]]:
    """(namespace, property, container, place, language, value) of a metadata packet.

    A document type declaration raises before anything is parsed. Containers are ``Bag``,
    ``Seq`` or ``Alt``, else empty; a structure's fields are named by their path.
    """
    if b"<!doctype" in packet.lower():
        raise ValueError("a document type declaration")

    def walk(ns: str, name: str, node: ET.Element) -> Iterator[tuple]:
        box = next((c for c in node if c.tag in (f"{_RDF}Bag", f"{_RDF}Seq", f"{_RDF}Alt")), None)
        if box is not None:
            for k, li in enumerate(box):
                if len(li):
                    for sub in li:
                        yield from walk(ns, f"{name}[{k + 1}]/{sub.tag.rpartition('}')[2]}", sub)
                else:
                    yield ns, name, box.tag.removeprefix(_RDF), k, li.get(_XML), (li.text or "").strip()
        elif len(node):
            for sub in node:
                inner = sub if sub.tag == f"{_RDF}Description" else None
                for x in inner if inner is not None else [sub]:
                    yield from walk(ns, f"{name}/{x.tag.rpartition('}')[2]}", x)
        else:
            yield ns, name, "", 0, None, (node.text or "").strip()

    for top in ET.fromstring(packet).iter(f"{_RDF}Description"):
        if top.get(f"{_RDF}about") is None:
            continue
        for k, v in top.attrib.items():
            ns, _, name = k[1:].partition("}")
            if not k.startswith(_RDF) and k.startswith("{"):
                yield ns, name, "", 0, None, v
        for node in top:
            ns, _, name = node.tag[1:].partition("}")
            yield from walk(ns, name, node)


def xmp(docs: DataFrame, key: str) -> DataFrame:
    return pdf.flat(docs, key, "namespace string, property string, container string, place int, lang string, value string", _safe(xmp_rows))


def _safe(f):
    def rows(data: bytes):
        try:
            yield from list(f(data))
        except ET.ParseError:
            return

    return rows


# forms ----------------------------------------------------------------------------------


def fdf_rows(data: bytes) -> Iterator[tuple[str, str]]:
    """(qualified name, value) of the fields in a form-data file; partial names are joined by dots."""
    f = File.open(data) if b"startxref" in data else _scanned(data)

    def text(v) -> str:
        if isinstance(v, bytes):
            return v[2:].decode("utf-16-be", "replace") if v.startswith(b"\xfe\xff") else v.decode("latin-1")
        return str(v)

    def walk(fields, above: str, seen: frozenset) -> Iterator[tuple[str, str]]:
        for ref in f.get(fields) or []:
            if isinstance(ref, Ref) and ref.num in seen:
                continue
            node = f.get(ref)
            if not isinstance(node, dict):
                continue
            name = ".".join(x for x in (above, text(f.get(node.get("T"))) if "T" in node else "") if x)
            if "V" in node:
                yield name, text(f.get(node["V"]))
            yield from walk(node.get("Kids"), name, seen | ({ref.num} if isinstance(ref, Ref) else set()))

    root = f.get(f.trailer.get("Root")) or {}
    yield from walk((f.get(root.get("FDF")) or {}).get("Fields"), "", frozenset())


def _scanned(data: bytes) -> File:
    f = File(data)
    f.recover()
    return f


def xfdf_rows(data: bytes) -> Iterator[tuple[str, str]]:
    """(qualified name, value) of an XFDF document; another root, or a document type declaration, raises."""
    if b"<!doctype" in data.lower():
        raise ValueError("a document type declaration")
    root = ET.fromstring(data)
    if root.tag.rpartition("}")[2] != "xfdf":
        raise ValueError("the root isn't xfdf")

    def walk(node: ET.Element, above: str) -> Iterator[tuple[str, str]]:
        for x in node:
            if x.tag.rpartition("}")[2] == "field":
                name = ".".join(p for p in (above, x.get("name", "")) if p)
                for v in x:
                    if v.tag.rpartition("}")[2] == "value":
                        yield name, v.text or ""
                yield from walk(x, name)

    for x in root:
        if x.tag.rpartition("}")[2] == "fields":
            yield from walk(x, "")


def form_data(docs: DataFrame, key: str, xml: bool) -> DataFrame:
    """(key, name, value) of form-data files."""
    return pdf.flat(docs, key, "name string, value string", _safe(xfdf_rows if xml else fdf_rows))


def xfdf(fields: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, xfdf): the fields of each key as one XFDF text, by name; a null value leaves the element empty."""
    item = F.concat(F.lit('<field name="'), escape_html(name), F.lit('">'), F.coalesce(F.concat(F.lit("<value>"), escape_html(value), F.lit("</value>")), F.lit("")), F.lit("</field>"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), item.alias("x"))))
    inner = F.array_join(F.transform(rows, lambda r: r["x"]), "")
    return fields.groupBy(*keys).agg(F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'), inner, F.lit("</fields></xfdf>")).alias("xfdf"))


def fdf(fields: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, fdf): the fields of each key as one form-data file, by name; a null value leaves the field without one.

    A qualified name is a chain of partial names, each the only kid of the one before.
    Texts are written as digits of UTF-16 behind its mark, so they may hold anything.
    """
    text = lambda c: F.concat(F.lit("<FEFF"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))
    steps = F.split(name, r"\.", -1)
    above = F.array_join(F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda n: F.concat(F.lit("<</T"), text(n), F.lit("/Kids["))), "")
    own = F.concat(F.lit("<</T"), text(F.element_at(steps, -1)), F.coalesce(F.concat(F.lit("/V"), text(F.col(value))), F.lit("")), F.lit(">>"))
    item = F.concat(above, own, F.repeat(F.lit("]>>"), F.size(steps) - 1))
    rows = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), item.alias("x"))))
    inner = F.array_join(F.transform(rows, lambda r: r["x"]), "")
    whole = F.concat(F.lit("%FDF-1.2\n1 0 obj\n<</FDF<</Fields["), inner, F.lit("]>>>>\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF\n"))
    return fields.groupBy(*keys).agg(F.encode(whole, "UTF-8").alias("fdf"))


# encryption -----------------------------------------------------------------------------

#: What fills a short password up to 32 bytes (fixed value).
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def file_key(password: bytes, owner: bytes, permissions: int, ident: bytes, revision: int, length: int = 5, metadata: bool = True) -> bytes:
    """The key of a file under the standard handler's revisions 2 to 4."""
    h = hashlib.md5((password + PAD)[:32] + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + ident + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    n = 5 if revision == 2 else length
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:n]).digest()
    return h[:n]


def owner_entry(owner: bytes, user: bytes, revision: int, length: int = 5) -> bytes:
    h = hashlib.md5((owner + PAD)[:32]).digest()
    n = 5 if revision == 2 else length
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:n]).digest()
    out = (user + PAD)[:32]
    for k in range(20 if revision >= 3 else 1):
        out = codecs.rc4(bytes(b ^ k for b in h[:n]), out)
    return out


def user_entry(key: bytes, ident: bytes, revision: int) -> bytes:
    if revision == 2:
        return codecs.rc4(key, PAD)
    out = hashlib.md5(PAD + ident).digest()
    for k in range(20):
        out = codecs.rc4(bytes(b ^ k for b in key), out)
    return out + bytes(16)


def opens(password: bytes, user: bytes, owner: bytes, permissions: int, ident: bytes, revision: int, length: int = 5) -> bytes | None:
    """The file's key if the user password is right, else null."""
    key = file_key(password, owner, permissions, ident, revision, length)
    n = 32 if revision == 2 else 16
    return key if user_entry(key, ident, revision)[:n] == user[:n] else None


def object_key(key: bytes, num: int, gen: int, aes: bool = False) -> bytes:
    extra = num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
    return hashlib.md5(key + extra).digest()[: min(len(key) + 5, 16)]


def range_digest(data: Column, ranges: list[tuple[int, int]], bits: int = 256) -> Column:
    """The SHA-2 digest of the bytes in (offset, length) ranges, as a signature covers them."""
    return F.sha2(F.concat(*[F.substring(data, a + 1, n) for a, n in ranges]), bits)
