"""Character maps and encodings: their parse on the driver or in a task, and lookups as joins."""

from __future__ import annotations

import re
import unicodedata
from binascii import unhexlify
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.objects import Parser, Word

#: What most tables of single codes are, from their beginning to their end: pairs of strings of whole bytes.
_SINGLE = re.compile(rb"(?:[\x00\t\n\x0c\r ]*+<(?:[0-9A-Fa-f]{2})*+>[\x00\t\n\x0c\r ]*+<(?:[0-9A-Fa-f]{2})*+>)*+[\x00\t\n\x0c\r ]*+endbfchar(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STRING = re.compile(rb"<([0-9A-Fa-f]*+)>")

@dataclass
class CMap:
    """Codespaces (low, high), code -> CID ranges (low, high, length, base) and code -> text."""

    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    cids: list[tuple[int, int, int, int]] = field(default_factory=list)
    texts: dict[bytes, str] = field(default_factory=dict)
    #: bf ranges that cover many codes: (low, high, length, text of the low code)
    spans: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    vertical: bool = False

    def length(self, data: bytes, at: int) -> int:
        """Bytes of the code at a place: the first codespace whose bounds hold byte by byte."""
        for lo, hi in sorted(self.spaces, key=lambda s: len(s[0])):
            part = data[at : at + len(lo)]
            if len(part) == len(lo) and all(a <= c <= b for a, c, b in zip(lo, part, hi)):
                return len(lo)
        return min(map(len, (lo for lo, _ in self.spaces)), default=1)

    def codes(self, data: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(data):
            n = max(1, self.length(data, at))
            out.append(data[at : at + n])
            at += n
        return out

    def cid(self, code: bytes) -> int:
        c = int.from_bytes(code, "big")
        return next((base + c - lo for lo, hi, n, base in self.cids if n == len(code) and lo <= c <= hi), -1)

    def text(self, code: bytes) -> str | None:
        if code in self.texts:
            return self.texts[code]
        c = int.from_bytes(code, "big")
        for lo, hi, n, base in self.spans:
            if n == len(code) and lo <= c <= hi:
                return _utf16(_plus(base, c - lo))
        return None


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-be" if len(b) > 1 else "latin-1", "replace")


def _plus(base: bytes, n: int) -> bytes:
    """The target of the n-th code of a range: its last two bytes go on."""
    tail = (int.from_bytes(base[-2:], "big") + n) & (256 ** min(2, len(base)) - 1)
    return base[:-2] + tail.to_bytes(min(2, len(base)), "big")


def parse(data: bytes, strict: bool = False) -> CMap:
    """The maps of a CMap program; what it doesn't understand it passes over.

    Ranges that go down are dropped. Where a target's last byte runs over inside a range,
    the strict mode ends the range there, else it goes on.
    """
    out, p, stack = CMap(), Parser(data), []
    while p.skip() < len(data):
        v = p.value(refs=False)
        if not isinstance(v, Word):
            stack.append(v)
            continue
        if v == "beginbfchar" and (m := _SINGLE.match(data, p.at)):
            held = list(map(unhexlify, _STRING.findall(data, m.start(), m.end())))
            out.texts |= {a: _utf16(b) for a, b in zip(held[0::2], held[1::2])}
            p.at = m.end()
        elif v == "endcodespacerange":
            out.spaces += [(a, b) for a, b in zip(stack[0::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) == len(b)]
        elif v == "endcidrange":
            out.cids += [(int.from_bytes(a, "big"), int.from_bytes(b, "big"), len(a), c) for a, b, c in _rows(stack, 3) if a <= b]
        elif v == "endcidchar":
            out.cids += [(int.from_bytes(a, "big"), int.from_bytes(a, "big"), len(a), c) for a, c in _rows(stack, 2)]
        elif v == "endbfchar":
            out.texts |= {a: _utf16(b) for a, b in _rows(stack, 2) if isinstance(b, bytes)}
        elif v == "endbfrange":
            for a, b, c in _rows(stack, 3):
                _range(out, a, b, c, strict)
        elif v == "def" and len(stack) >= 2 and stack[-2] == "WMode":
            out.vertical = stack[-1] == 1
        stack = []
    return out


def _rows(stack: list, n: int) -> list[tuple]:
    rows = [tuple(stack[i : i + n]) for i in range(0, len(stack) - n + 1, n)]
    return [r for r in rows if all(isinstance(x, bytes) for x in r[: max(1, n - 1)])]


def _range(out: CMap, a: bytes, b: bytes, target, strict: bool) -> None:
    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    if hi < lo or len(a) != len(b):
        return
    if isinstance(target, list):
        out.texts |= {(lo + k).to_bytes(len(a), "big"): _utf16(t) for k, t in enumerate(target[: hi - lo + 1]) if isinstance(t, bytes)}
    elif isinstance(target, bytes) and target:
        if strict:
            hi = min(hi, lo + 255 - target[-1])
        out.spans.append((lo, hi, len(a), target))


def bf_rows(ranges: DataFrame) -> DataFrame:
    """(code, unicode) from rows (lo, hi, base, targets): one base that goes on, or a target for each code.

    Ranges that go down vanish; a list shorter than its range leaves the rest unmapped.
    """
    each = ranges.where("hi >= lo").withColumn("code", F.explode(F.sequence("lo", "hi")))
    unicode = F.when(F.col("targets").isNotNull(), F.expr("try_element_at(targets, CAST(code - lo + 1 AS INT))")).otherwise(F.col("base") + F.col("code") - F.col("lo"))
    return each.select("code", unicode.alias("unicode")).where("unicode IS NOT NULL")


def glyph_text(name: str) -> str | None:
    """What a glyph name stands for: ``uniXXXX``, ``uXXXXXX``, a letter, or a name of the character database; suffixes go."""
    name = name.split(".")[0]
    if len(name) == 1:
        return name
    for lead in ("uni", "u"):
        digits = name.removeprefix(lead)
        if name.startswith(lead) and 4 <= len(digits) <= 6 and all(c in "0123456789ABCDEF" for c in digits):
            return chr(int(digits, 16))
    marks = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}
    for mark, c in marks.items():
        if name.endswith(mark) and len(name) == len(mark) + 1:
            return unicodedata.normalize("NFC", name[0] + c)
    try:
        return unicodedata.lookup(NAMES.get(name, name))
    except KeyError:
        return None


#: Glyph names whose character has another name (fixed values).
NAMES = {
    "exclam": "EXCLAMATION MARK", "quotedbl": "QUOTATION MARK", "numbersign": "NUMBER SIGN", "dollar": "DOLLAR SIGN", "percent": "PERCENT SIGN", "quotesingle": "APOSTROPHE",
    "parenleft": "LEFT PARENTHESIS", "parenright": "RIGHT PARENTHESIS", "plus": "PLUS SIGN", "hyphen": "HYPHEN-MINUS", "period": "FULL STOP", "slash": "SOLIDUS",
    "zero": "DIGIT ZERO", "one": "DIGIT ONE", "two": "DIGIT TWO", "three": "DIGIT THREE", "four": "DIGIT FOUR", "five": "DIGIT FIVE", "six": "DIGIT SIX", "seven": "DIGIT SEVEN", "eight": "DIGIT EIGHT", "nine": "DIGIT NINE",
    "less": "LESS-THAN SIGN", "equal": "EQUALS SIGN", "greater": "GREATER-THAN SIGN", "question": "QUESTION MARK", "at": "COMMERCIAL AT", "bracketleft": "LEFT SQUARE BRACKET", "backslash": "REVERSE SOLIDUS",
    "bracketright": "RIGHT SQUARE BRACKET", "asciicircum": "CIRCUMFLEX ACCENT", "underscore": "LOW LINE", "grave": "GRAVE ACCENT", "braceleft": "LEFT CURLY BRACKET", "bar": "VERTICAL LINE", "braceright": "RIGHT CURLY BRACKET",
    "asciitilde": "TILDE", "germandbls": "LATIN SMALL LETTER SHARP S", "quoteleft": "LEFT SINGLE QUOTATION MARK", "quoteright": "RIGHT SINGLE QUOTATION MARK", "quotedblleft": "LEFT DOUBLE QUOTATION MARK",
    "quotedblright": "RIGHT DOUBLE QUOTATION MARK", "endash": "EN DASH", "emdash": "EM DASH", "ellipsis": "HORIZONTAL ELLIPSIS", "Euro": "EURO SIGN", "fi": "LATIN SMALL LIGATURE FI", "fl": "LATIN SMALL LIGATURE FL",
}


def encoding(name: str) -> dict[int, str]:
    """Code -> text of a simple font's base encoding, from the code pages that it equals."""
    page = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "StandardEncoding": "latin-1"}[name]
    out = {c: bytes([c]).decode(page, "replace") for c in range(32, 256)}
    return {c: t for c, t in out.items() if t != "�"}


def encoding_rows(spark: SparkSession, name: str) -> DataFrame:
    """(code, text): at most 224 rows, for a broadcast join."""
    return spark.createDataFrame(sorted(encoding(name).items()), "code int, text string")
