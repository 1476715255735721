"""The object layer of a PDF file: values, indirect objects, cross-references, recovery, and a writer."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from quire.functions import codecs

SPACE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_HEX = re.compile(rb"<([^>]*)>?")
_HEAD = re.compile(rb"(?<![0-9A-Za-z])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![0-9A-Za-z])")
#: What a backslash makes of the letter behind it (fixed values).
_ESCAPE = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Name(str):
    """A name object, without its slash and with ``#xx`` resolved."""


class Word(str):
    """A keyword: an operator of a content stream, or a word that no value starts with."""


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    """A dictionary with bytes as they stand in the file."""

    head: dict
    raw: bytes = b""

    def chain(self) -> tuple[list[str], list[dict]]:
        """Names of the filters and their parameters, one each."""
        names, params = self.head.get("Filter", []), self.head.get("DecodeParms", {})
        names = [names] if isinstance(names, str) else list(names or [])
        params = params if isinstance(params, list) else [params]
        return names, [p if isinstance(p, dict) else {} for p in params] + [{}] * len(names)

    def data(self) -> bytes:
        names, params = self.chain()
        return codecs.decode(self.raw, names, params)


class Parser:
    """Values one after another from a position in the bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> int:
        if self.at < len(self.data) and (c := self.data[self.at]) > 0x20 and c != 0x25:
            return self.at
        self.at = _SKIP.match(self.data, self.at).end()
        return self.at

    def literal(self) -> bytes:
        """A string in parentheses, which may nest; octal codes and line ends by the usual rules."""
        out, depth, i, data = bytearray(), 1, self.at + 1, self.data
        while i < len(data):
            c = data[i]
            i += 1
            if c == 0x5C and i < len(data):
                e = data[i]
                i += 1
                if 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, i - 1)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                elif e in (10, 13):
                    i += e == 13 and data[i : i + 1] == b"\n"
                else:
                    out += _ESCAPE.get(e, bytes([e]))
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 13:
                i += data[i : i + 1] == b"\n"
                c = 10
            out.append(c)
        self.at = i
        return bytes(out)

    def value(self, refs: bool = True) -> Any:
        """The next value; a ``Word`` where none starts; None at the end, too."""
        data, at = self.data, self.skip()
        c = data[at : at + 1]
        if c == b"/":
            m = _WORD.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            if b"#" in raw:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("utf-8", "replace"))
        if c == b"(":
            return self.literal()
        if c == b"<" and data.startswith(b"<<", at):
            self.at = at + 2
            out = {}
            while True:
                key = self.value(refs)
                if not isinstance(key, Name):
                    if key is None or key == ">>":
                        return out
                    continue  # a stray value: go on with the next name
                item = self.value(refs)
                if isinstance(item, Word):
                    if item == ">>":
                        return out
                    continue
                out[str(key)] = item
        if c == b"<":
            m = _HEX.match(data, at)
            self.at = m.end()
            try:
                return bytes.fromhex(m[1].decode("ascii"))
            except ValueError:  # an odd digit, a split pair or no digit
                return codecs.ascii_hex_decode(bytes(x for x in m[1] if x not in SPACE))
        if c == b"[":
            self.at, out = at + 1, []
            while True:
                if self.skip() >= len(data):
                    return out
                item = self.value(refs)
                if isinstance(item, Word) and item == "]":
                    return out
                out.append(item)
        if refs and c.isdigit() and (m := _REF.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        if data.startswith(b">>", at):
            self.at = at + 2
            return Word(">>")
        if m := _WORD.match(data, at):
            self.at = m.end()
            return {b"true": True, b"false": False, b"null": None}.get(m[0], Word(m[0].decode("latin-1")))
        self.at = at + 1
        return Word(c.decode("latin-1")) if c else None

    def indirect(self) -> tuple[int, int, Any] | None:
        """(number, generation, value) of the object that starts here, a stream with its bytes."""
        m = _HEAD.match(self.data, self.skip())
        if not m:
            return None
        self.at = m.end()
        value = self.value()
        self.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", self.at):
            value = self._stream(value)
        return int(m[1]), int(m[2]), value

    def _stream(self, head: dict) -> Stream:
        begin = self.at + 6
        begin += 2 if self.data.startswith(b"\r\n", begin) else self.data[begin : begin + 1] in (b"\n", b"\r")
        n = head.get("Length")
        if isinstance(n, int) and n >= 0 and re.compile(rb"\s*endstream").match(self.data, begin + n):
            raw = self.data[begin : begin + n]
        else:  # no length or a wrong one: up to the end mark, without the line end before it
            end = self.data.find(b"endstream", begin)
            raw = self.data[begin : end if end >= 0 else len(self.data)]
            raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw.endswith((b"\n", b"\r")) else raw
        self.at = begin + len(raw)
        return Stream(head, raw)


def xref_rows(data: bytes, widths: list[int], index: list[int]) -> list[tuple[int, int, int, int]]:
    """(number, type, field 2, field 3) of a decoded cross-reference stream; free and cut-off entries are left out.

    ``index`` holds first numbers and counts in turn. A first width of 0 means type 1.
    Type 2 gives the container's number and the place in it.
    """
    out, at, step = [], 0, sum(widths)
    for first, count in zip(index[0::2], index[1::2]):
        for n in range(first, first + count):
            if not step or at + step > len(data):
                return out
            fields = []
            for w in widths:
                fields.append(int.from_bytes(data[at : at + w], "big"))
                at += w
            kind = fields[0] if widths[0] else 1
            if kind:
                out.append((n, kind, fields[1], fields[2]))
    return out


@dataclass
class File:
    """A file's objects by number, through its cross-references or, failing these, by recovery.

    ``where``: number -> ("at", offset) or ("in", container, place); the newest section
    that names a number counts. ``sections`` says in which order they were read.
    """

    data: bytes
    where: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    sections: list[tuple[str, int]] = field(default_factory=list)
    recovered: bool = False
    _held: dict[int, Any] = field(default_factory=dict)
    _packed: dict[int, list[tuple[int, Any]]] = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes) -> File:
        f = cls(data)
        try:
            f._chain()
            good = isinstance(f.get(f.trailer.get("Root")), dict)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError):
            good = False
        if not good:
            f.recover()
        return f

    @property
    def version(self) -> str | None:
        m = re.search(rb"%PDF-(\d+\.\d+)", self.data[:1024])
        return m[1].decode() if m else None

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        todo = [int(re.compile(rb"startxref\s+(\d+)").match(self.data, at)[1])]
        seen = set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            p = Parser(self.data, at)
            if self.data.startswith(b"xref", p.skip()):
                head = self._table(p.at + 4)
                self.sections.append(("table", at))
                if isinstance(head.get("XRefStm"), int):
                    todo.insert(0, head["XRefStm"])
            else:
                s = p.indirect()[2]
                head = s.head
                self.sections.append(("stream", at))
                for n, kind, a, b in xref_rows(s.data(), head["W"], head.get("Index", [0, head["Size"]])):
                    if kind in (1, 2):
                        self.where.setdefault(n, ("at", a) if kind == 1 else ("in", a, b))
            for k, v in head.items():
                self.trailer.setdefault(k, v)
            if isinstance(head.get("Prev"), int):
                todo.append(head["Prev"])

    def _table(self, at: int) -> dict:
        section = re.compile(rb"\s*(\d+)\s+(\d+)\s*?[\r\n ]+(?=\d{10} )")
        entry = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])")
        while m := section.match(self.data, at):
            at = m.end()
            for n in range(int(m[1]), int(m[1]) + int(m[2])):
                e = entry.match(self.data, at)
                if not e:
                    break
                at = e.end()
                if e[3] == b"n":
                    self.where.setdefault(n, ("at", int(e[1])))
        p = Parser(self.data, at)
        if p.value() != "trailer":
            raise ValueError("a cross-reference table without trailer")
        return p.value()

    def recover(self) -> None:
        """Find ``N G obj`` wherever it stands: the highest generation counts, and of equal ones the last.

        Objects inside object streams are found, too, unless the file has them outside.
        """
        self.recovered, self.sections = True, [("scan", 0)]
        self.where, self.trailer, self._held, self._packed = {}, {}, {}, {}
        best: dict[int, tuple[int, int]] = {}
        for m in _HEAD.finditer(self.data):
            n = int(m[1])
            best[n] = max(best.get(n, (-1, -1)), (int(m[2]), m.start()))
        self.where = {n: ("at", at) for n, (_, at) in best.items()}
        for n, _ in sorted(self.where.items(), key=lambda x: -x[1][1]):  # the last container counts
            s = self.get(Ref(n))
            if isinstance(s, Stream) and s.head.get("Type") == "ObjStm":
                for k, (inner, _) in enumerate(self.packed(n)):
                    self.where.setdefault(inner, ("in", n, k))
        for m in re.finditer(rb"trailer", self.data):
            head = Parser(self.data, m.end()).value()
            if isinstance(head, dict):
                self.trailer.update(head)
        for n in self.where:
            v = self.get(Ref(n))
            if isinstance(v, Stream) and v.head.get("Type") == "XRef":
                self.trailer = v.head | self.trailer
            elif isinstance(v, dict) and v.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n))

    def packed(self, container: int) -> list[tuple[int, Any]]:
        """(number, value) of the objects in an object stream, in its order."""
        if container not in self._packed:
            s = self.get(Ref(container))
            if not isinstance(s, Stream) or not isinstance(s.head.get("N"), int) or not isinstance(s.head.get("First"), int):
                return []
            data = s.data()
            head = Parser(data)
            pairs = [(head.value(), head.value()) for _ in range(s.head["N"])]
            self._packed[container] = [(n, Parser(data, s.head["First"] + at).value()) for n, at in pairs if isinstance(n, int) and isinstance(at, int)]
        return self._packed[container]

    def get(self, v: Any) -> Any:
        """A value, looked up if it is a reference; a dangling one is null."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            if v.num not in self._held:
                place, self._held[v.num] = self.where.get(v.num), None
                if place and place[0] == "at":
                    got = Parser(self.data, place[1]).indirect()
                    if got is None or got[0] != v.num:
                        raise ValueError(f"object {v.num} isn't where the cross-reference says")
                    self._held[v.num] = got[2]
                elif place:
                    # the numbers in the container's head decide, the place in the cross-reference is a hint
                    inner = self.packed(place[1])
                    k = place[2]
                    self._held[v.num] = inner[k][1] if k < len(inner) and inner[k][0] == v.num else dict(inner).get(v.num)
            v = self._held[v.num]
        return None

    def objects(self) -> list[tuple[int, str, int, int | None, Any]]:
        """(number, "at" or "in", offset or container, place, value) of every object, by number."""
        return [(n, w[0], w[1], w[2] if w[0] == "in" else None, self.get(Ref(n))) for n, w in sorted(self.where.items())]

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit from the nodes above them; a node is visited once."""
        out, seen = [], set()

        def walk(v: Any, above: dict) -> None:
            if isinstance(v, Ref):
                if v.num in seen:
                    return
                seen.add(v.num)
            node = self.get(v)
            if not isinstance(node, dict):
                return
            have = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if isinstance(self.get(node.get("Kids")), list):
                for kid in self.get(node["Kids"]):
                    walk(kid, have)
            else:
                out.append(have | node)

        root = self.get(self.trailer.get("Root")) or {}
        walk(root.get("Pages"), {})
        return out

    def content(self, page: dict) -> bytes:
        """The page's content streams, one after another with a line end between."""
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(s.data() for s in map(self.get, parts) if isinstance(s, Stream))


# writing --------------------------------------------------------------------------------


_UNSAFE, _MARKED = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]"), re.compile(rb"[()\\]")


@lru_cache(4096)
def _name(v: str) -> bytes:
    return b"/" + _UNSAFE.sub(lambda m: b"#%02X" % m[0][0], v.encode())


def dump(v: Any) -> bytes:
    """A value in a file's syntax."""
    if type(v) is bytes:
        return b"(" + _MARKED.sub(rb"\\\g<0>", v).replace(b"\r", b"\\r") + b")"
    if type(v) is int:
        return b"%d" % v
    if type(v) is Name:
        return _name(v)
    if type(v) is Ref:
        return b"%d %d R" % (v.num, v.gen)
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return _name(v)
    if isinstance(v, (int, Word)):
        return str(v).encode()
    if isinstance(v, float):
        return (b"%.6f" % v).rstrip(b"0").rstrip(b".")
    if isinstance(v, bytes):
        return dump(bytes(v))
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, list):
        return b"[" + b" ".join(map(dump, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join([_name(k) + b" " + dump(x) for k, x in v.items()]) + b">>"
    if isinstance(v, Stream):
        return dump(v.head | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise TypeError(type(v))


def flate(data: bytes, **head: Any) -> Stream:
    return Stream(head | {"Filter": Name("FlateDecode")}, zlib.compress(data))


def write(objects: dict[int, Any], root: int, packed: int = 0, before: bytes = b"", prev: int | None = None, free: int = 0, info: int | None = None) -> bytes:
    """A whole file, or with ``before`` and ``prev`` an update behind one.

    ``packed`` > 0: so many objects share an object stream (streams and the root stay
    outside), and the cross-references are a stream; else they are a table. ``free`` is
    the first number that such streams may take; an update must give one.
    """
    out = bytearray(before or b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    where: dict[int, tuple[int, int, int]] = {}

    def put(n: int, v: Any) -> None:
        where[n] = (1, len(out), 0)
        out.extend(b"%d 0 obj\n" % n + dump(v) + b"\nendobj\n")

    inside = [n for n, v in sorted(objects.items()) if packed and not isinstance(v, Stream) and n != root]
    for n, v in sorted(objects.items()):
        if n not in inside:
            put(n, v)
    free = max(free, max(objects) + 1)
    for k in range(0, len(inside), packed or 1):
        part = inside[k : k + packed]
        bodies, heads, at = [dump(objects[n]) for n in part], [], 0
        for i, (n, b) in enumerate(zip(part, bodies)):
            where[n] = (2, free, i)
            heads.append(b"%d %d" % (n, at))
            at += len(b) + 1
        head = b" ".join(heads) + b"\n"
        put(free, flate(head + b"\n".join(bodies), Type=Name("ObjStm"), N=len(part), First=len(head)))
        free += 1
    start, size = len(out), max(free, max(objects) + 1)
    tail = {"Size": size, "Root": Ref(root)} | ({"Prev": prev} if prev is not None else {}) | ({"Info": Ref(info)} if info else {})
    if packed:
        where[free] = (1, start, 0)
        numbers = sorted(where)
        rows = b"".join(k.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in map(where.get, numbers))
        index = [x for n in numbers for x in (n, 1)]
        out.extend(b"%d 0 obj\n" % free + dump(flate(rows, Type=Name("XRef"), W=[1, 4, 2], Index=index, **tail | {"Size": free + 1})) + b"\nendobj\n")
    else:
        out.extend(b"xref\n")
        numbers = sorted(where)
        if not before:
            out.extend(b"0 1\n0000000000 65535 f \n")
        i = 0
        while i < len(numbers):
            j = i
            while j + 1 < len(numbers) and numbers[j + 1] == numbers[j] + 1:
                j += 1
            out.extend(b"%d %d\n" % (numbers[i], j - i + 1) + b"".join(b"%010d 00000 n \n" % where[n][1] for n in numbers[i : j + 1]))
            i = j + 1
        out.extend(b"trailer\n" + dump(tail) + b"\n")
    out.extend(b"startxref\n%d\n%%%%EOF\n" % start)
    return bytes(out)


def last_section(data: bytes) -> int:
    """Where the newest cross-reference section starts, for an update behind it."""
    return int(re.findall(rb"startxref\s+(\d+)", data)[-1])
