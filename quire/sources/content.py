"""Content streams: tokens, and the fold of the graphics state over them that yields what is shown."""

from __future__ import annotations

import re
from binascii import unhexlify
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat
from typing import Any

import numpy as np

from quire.sources.objects import Name, Parser, Word, dump

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_END_IMAGE = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
_S, _D = rb"[\x00\t\n\x0c\r ]", rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
_NUMBER = rb"[+-]?(?:\d++(?:\.\d*+)?|\.\d++)" + _D
_PAIRS = rb"<(?:[0-9A-Fa-f]{2})*+>"
#: What most tokens are: an array of numbers and hexadecimal strings, if need be with ``TJ``; a number, a string, a word, a name, a dictionary of one number. Anything else is left to the parser.
_USUAL = re.compile(rb"%b*+(?:\[((?:%b++|%b|%b)*+)\](?:%b*+(TJ)%b)?|(%b)|(%b)|([A-Za-z'\"][A-Za-z0-9*]*+)%b|/([A-Za-z0-9_.+-]++)%b|<</([A-Za-z]++) (\d++)>>)" % (_S, _S, _NUMBER, _PAIRS, _S, _D, _NUMBER, _PAIRS, _D, _D))
#: Arrays shown one after another, with numbers that can't be too long for what they are read as.
_SHOWN = re.compile(rb"(?:%b*+\[(?:%b++|[+-]?(?:\d{1,200}+(?:\.\d{0,200}+)?|\.\d{1,200}+)%b|%b)*+\]%b*+TJ%b)++" % (_S, _S, _D, _PAIRS, _S, _D))
#: Numbers, if any, and the operator behind them.
_OPERATION = re.compile(rb"%b*+((?:%b%b++)*+)([A-Za-z'\"][A-Za-z0-9*]*+)%b" % (_S, _NUMBER, _S, _D))
_ITEM = re.compile(rb"<([^>]*+)>|([^\x00\t\n\x0c\r <]++)")
#: An array of one hexadecimal string, behind a whole number at most, that is shown; and such arrays one after another.
_ONE = rb"%b*+\[(?:%b*+([+-]?\d{1,15}+)%b*+(?=<))?+%b*+<([0-9A-Fa-f]*+)>%b*+\]%b*+TJ%b" % (_S, _S, _S, _S, _S, _S, _D)
_ONE, _ONES = re.compile(_ONE), re.compile(rb"(?:%b)++" % _ONE.replace(b"([", b"(?:["))
#: Words that are values, and the one that bytes of any kind follow.
_OTHER = frozenset((b"true", b"false", b"null", b"ID"))
#: White space of a file as that of Python: it has a null byte more.
_BLANK = bytes.maketrans(b"\0", b" ")


def tokens(content: bytes, skip: Callable[[], bool] | None = None, many: bool = False) -> Iterator[tuple[str, list[Any] | None]]:
    """(operator, operands) in order. An inline image is ``BI``, ``ID`` with its dictionary and ``EI`` with its bytes.

    While ``skip`` says so, ``TJ`` may come with None in the place of well-formed operands, which then aren't read.
    ``many``: a row of ``TJ`` may come as one operator without a name, whose operands are
    the (number, hexadecimal digits) of each array, as they are spelled, or None for each.
    """
    p, operands, usual, operation, words = Parser(content), [], _USUAL.match, _OPERATION.match, {}
    while True:
        if skip and (m := _SHOWN.match(content, p.at)) and skip():
            n = content.count(b"TJ", m.start(), m.end())
            if many:
                yield "", [None] * n
            else:
                yield from repeat(("TJ", None), n)
            p.at, operands = m.end(), []
            continue
        m = operation(content, p.at)
        if m and (raw := m[2]) not in _OTHER:
            if m[1]:
                operands += [float(n) if b"." in n else int(n) for n in m[1].translate(_BLANK).split()]
            p.at = m.end()
            yield words.get(raw) or words.setdefault(raw, raw.decode()), operands
            operands = []
            continue
        m = usual(content, p.at)
        if m:
            kind = m.lastindex
            if kind <= 2:
                if many and kind == 2 and (row := _ONES.match(content, p.at)):
                    yield "", _ONE.findall(content, row.start(), row.end())
                    p.at, operands = row.end(), []
                    continue
                operands.append([(float(n) if b"." in n else int(n)) if n else unhexlify(x) for x, n in _ITEM.findall(m[1])])
                p.at = m.end()
                if kind == 2:
                    yield "TJ", operands
                    operands = []
                continue
            if kind != 5:
                operands.append((float(m[3]) if b"." in m[3] else int(m[3])) if kind == 3 else unhexlify(m[4][1:-1]) if kind == 4 else Name(m[6].decode()) if kind == 6 else {m[7].decode(): int(m[8])})
                p.at = m.end()
                continue
        if p.skip() >= len(content):
            return
        v = p.value(refs=False)
        if not isinstance(v, Word):
            operands.append(v)
            continue
        if v in ("]", ">>", ")", "}", "{"):
            continue
        if v == "ID":
            head = {str(k): x for k, x in zip(operands[0::2], operands[1::2])}
            begin = p.at + 1
            m = _END_IMAGE.search(content, p.at)
            end = m.start() if m else len(content)
            yield "ID", [head]
            yield "EI", [content[begin:end]]
            p.at = m.end() if m else len(content)
        else:
            yield str(v), operands
        operands = []


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass(frozen=True)
class Font:
    """How a font turns bytes into codes, text and widths (thousandths of the size).

    ``total``: it does so for any bytes, so a string that isn't asked for hides no fault of the file.
    ``step``: the bytes of a code, where all codes are alike, or 0.
    """

    name: str = ""
    codes: Callable[[bytes], list[bytes]] = lambda data: [data[i : i + 1] for i in range(len(data))]
    text: Callable[[bytes], str | None] = lambda code: code.decode("latin-1")
    width: Callable[[bytes], float] = lambda code: 500.0
    total: bool = False
    met: dict[bytes, tuple[str, float, bool]] = field(default_factory=dict, compare=False)
    said: dict[bytes, tuple[str, float, int, int]] = field(default_factory=dict, compare=False)
    step: int = 0
    known: dict[str, Any] = field(default_factory=dict, compare=False)

    def glyphs(self, data: bytes) -> list[tuple[str, float, bool]]:
        """(text, width, is the one-byte space) of each code; a code is looked up once."""
        out, met = [], self.met
        for code in self.codes(data):
            got = met.get(code)
            if got is None:
                got = met[code] = (self.text(code) or "", self.width(code), code == b" ")
            out.append(got)
        return out

    def string(self, data: bytes) -> tuple[str, float, int, int]:
        """(text, width, codes, one-byte spaces) of a string; one that comes again is looked up."""
        out = self.said.get(data)
        if out is None:
            met = self.met
            try:
                got = [met[c] for c in self.codes(data)]
            except KeyError:
                got = self.glyphs(data)
            text, width, space = zip(*got) if got else ((), (), ())
            out = self.said[data] = ("".join(text), sum(width), len(got), sum(space))
        return out

    def strings(self, digits: list[bytes]) -> tuple[list[str], Any, Any, Any] | None:
        """``string`` of many, in hexadecimal digits, as columns.

        For codes of two bytes that stand for a character each and are a whole number
        wide, so that sums are exact in any order; otherwise None.
        """
        if self.step != 2 or self.known.get("odd"):
            return None
        sizes = list(map(len, digits))
        if any(n & 3 for n in set(sizes)):
            return None
        data, known = unhexlify(b"".join(digits)), self.known
        low = data[1::2]
        if not low:
            return [""] * len(sizes), [0.0] * len(sizes), sizes, 0
        if data[0::2].strip(b"\0"):  # codes beyond a byte
            return self._wide(data, sizes)
        try:
            text = charmap_decode(low, "strict", known.get("signs", ""))[0]
        except UnicodeDecodeError:
            if not self._learn(set(low)):
                return None
            text = charmap_decode(low, "strict", known["signs"])[0]
        at, texts = 0, []
        for n in sizes:
            texts.append(text[at : at + (n >> 2)])
            at += n >> 2
        n = [n >> 2 for n in sizes]
        if len(every := known["every"]) == 1:
            width, = every
            return texts, [width * k for k in n], n, 0
        return texts, self._sums(known["widths"], np.frombuffer(low, np.uint8), n), n, 0

    def _wide(self, data: bytes, sizes: list[int]) -> tuple[list[str], Any, Any, Any] | None:
        codes, known = np.frombuffer(data, ">u2").astype(np.intp), self.known
        signs = known.setdefault("all", np.zeros(1 << 16, "<u4"))
        widths = known.setdefault("all widths", np.zeros(1 << 16))
        got = signs[codes]
        if not got.all():
            for c in set(codes[got == 0].tolist()):
                if not self._plain(c):
                    return None
                signs[c], widths[c] = ord(self.met[c.to_bytes(2, "big")][0]), self.met[c.to_bytes(2, "big")][1]
            got = signs[codes]
        text, at, texts, n = got.tobytes().decode("utf-32-le", "surrogatepass"), 0, [], [n >> 2 for n in sizes]
        for k in n:
            texts.append(text[at : at + k])
            at += k
        return texts, self._sums(widths, codes, n), n, 0

    def _sums(self, widths: Any, codes: Any, n: list[int]) -> Any:
        ends = np.cumsum(n)
        total = np.concatenate(([0.0], np.cumsum(widths[codes])))
        return (total[ends] - total[ends - n]).tolist()

    def _plain(self, code: int) -> bool:
        """Whether a code stands for one character and has a whole width; if not, none is taken by columns any more."""
        text, width, _ = self.glyphs(code.to_bytes(2, "big"))[0]
        if len(text) == 1 and text not in "\0\ufffe" and float(width).is_integer() and abs(width) <= 1e6:
            return True
        self.known["odd"] = True
        return False

    def _learn(self, codes: set[int]) -> bool:
        known = self.known
        signs, widths, every = list(known.get("signs", "\ufffe" * 256)), known.get("widths", np.zeros(256)), known.get("every", set())
        for c in codes:
            if signs[c] == "\ufffe":
                if not self._plain(c):
                    return False
                signs[c], widths[c], _ = self.met[c.to_bytes(2, "big")]
                every.add(float(widths[c]))
        known |= {"signs": "".join(signs), "widths": widths, "every": every}
        return True


@dataclass(frozen=True)
class State:
    """The graphics state; a saved copy is the same object, as none is ever changed."""

    ctm: Matrix = ONE
    fill: tuple = ("DeviceGray", 0.0)
    stroke: tuple = ("DeviceGray", 0.0)
    line: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple = ((), 0.0)
    flat: float = 0.0
    intent: str = "RelativeColorimetric"
    named: str = ""
    clip: int = 0
    font: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


#: Colours set in a device space: operator -> (which, space, components).
_DEVICE = {"g": ("fill", "DeviceGray", 1), "rg": ("fill", "DeviceRGB", 3), "k": ("fill", "DeviceCMYK", 4), "G": ("stroke", "DeviceGray", 1), "RG": ("stroke", "DeviceRGB", 3), "K": ("stroke", "DeviceCMYK", 4)}
#: Numbers of the state that an operator sets.
_PLAIN = {"w": "line", "J": "cap", "j": "join", "M": "miter", "i": "flat", "Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise", "Tr": "mode"}
#: Painting a path: operator -> (closed first, filled by rule, stroked).
_PAINT = {"S": (0, "", 1), "s": (1, "", 1), "f": (0, "nonzero", 0), "F": (0, "nonzero", 0), "f*": (0, "evenodd", 0), "B": (0, "nonzero", 1), "B*": (0, "evenodd", 1), "b": (1, "nonzero", 1), "b*": (1, "evenodd", 1), "n": (0, "", 0)}


@dataclass
class Event:
    """Something that a stream shows or marks: kind, details by name, and the marked content that it stands in."""

    kind: str
    seq: int
    state: State
    facts: dict[str, Any]
    marks: tuple = field(default_factory=tuple)


def fold(content: bytes, fonts: dict[str, Font] | None = None, properties: dict[str, dict] | None = None, shows: str = "placed", many: bool = False) -> Iterator[Event]:
    """Events in order: ``text``, ``path``, ``image`` (inline), ``object`` (by name), ``shading``, ``point`` (of marked content).

    Operators with missing or wrong operands do nothing, unknown ones too; a restore
    without a save and an end of marked content without a begin are passed over. A
    property list that is named but unknown opens no sequence. ``shows``: the texts come
    "placed", "said" (those of ``TJ`` without place) or not at all ("", where they are well-formed).
    ``many``: strings shown one after another may come as one event ``texts``, whose facts
    are lists: those of ``text`` that differ between them, and ``seq``; strings without text aren't in it.
    """
    fonts, properties, plain = fonts or {}, properties or {}, Font(total=True)
    s, saved, marks = State(), [], []
    tm = tlm = ONE
    path: list[tuple] = []
    at = begin = (0.0, 0.0)
    clip = ""

    def move(x: float, y: float) -> None:
        nonlocal tm, tlm
        tm = tlm = multiply((1.0, 0.0, 0.0, 1.0, x, y), tlm)

    def shown(parts: list) -> dict:
        """The text, place and advance of strings and moves between them; the matrix moves on."""
        nonlocal tm
        a, b, c, d, e, f = tm
        font, size, char, word, scale = fonts.get(s.font, plain), s.size, s.char, s.word, s.scale
        start, text, total = None, [], 0.0
        for part in parts:
            if isinstance(part, bytes):
                start = start or (e, f)  # a move before the first string is no part of the run
                t, width, n, spaces = font.said.get(part) or font.string(part)
                n = (width / 1000 * size + n * char + (word * spaces if word else 0.0)) * scale
                text.append(t)
            elif isinstance(part, (int, float)):
                n = -part / 1000 * size * scale
            else:
                continue
            e, f = n * a + e, n * b + f
            if start:
                total += n
        tm = a, b, c, d, e, f
        m = multiply((a, b, c, d, *(start or (e, f))), s.ctm)
        x, y = apply(m, 0.0, s.rise)
        return {"text": text[0] if len(text) == 1 else "".join(text), "x": x, "y": y, "width": total * abs(m[0] or m[1]), "font_size": size * (abs(m[3]) or abs(m[2]) or 1.0), "font": s.font, "matrix": m}

    def said(parts: list) -> dict:
        font, text = fonts.get(s.font, plain), []
        for part in parts:
            if isinstance(part, bytes):
                text.append((font.said.get(part) or font.string(part))[0])
            elif isinstance(part, (int, float)):
                part / 1000  # too large a number is a fault in any case
        return {"text": text[0] if len(text) == 1 else "".join(text)}

    def several(pairs: list[tuple[bytes, bytes]]) -> dict:
        """``shown`` of arrays of a number, if any, and a string, one after another."""
        nonlocal tm
        font, at = fonts.get(s.font, plain), seq
        got = font.strings([d for _, d in pairs])
        texts, width, n, spaces = got if got else zip(*[font.string(unhexlify(d + b"0" * (len(d) % 2))) for _, d in pairs])
        out = {"seq": list(range(at, at + len(pairs))), "text": list(texts)}
        if shows != "said":
            a, b, c, d, e, f = tm
            size, char, word, scale = s.size, s.char, s.word, s.scale
            p, q, r, t, u, v = s.ctm
            m = multiply((a, b, c, d, 0.0, 0.0), s.ctm)
            right, up, over = m[0] * 0.0 + m[2] * s.rise, m[1] * 0.0 + m[3] * s.rise, abs(m[0] or m[1])
            move = {x: -int(x) / 1000 * size * scale for x in {x for x, _ in pairs} if x}
            xs, ys, wide, blanks = [], [], [], spaces or repeat(0)
            for (x, _), w, k, blank in zip(pairs, width, n, blanks):
                if x:
                    x = move[x]
                    e, f = x * a + e, x * b + f
                xs.append(right + (e * p + f * r + u))
                ys.append(up + (e * q + f * t + v))
                w = (w / 1000 * size + k * char + (word * blank if word else 0.0)) * scale
                wide.append(w * over)
                e, f = w * a + e, w * b + f
            tm = a, b, c, d, e, f
            out |= {"x": xs, "y": ys, "width": wide}
        if not all(texts):
            out = {k: [x for x, text in zip(v, texts) if text] for k, v in out.items()}
        return out if shows == "said" else out | {"font_size": size * (abs(m[3]) or abs(m[2]) or 1.0), "font": s.font}

    seq = -1
    for op, args in tokens(content, None if shows else lambda: fonts.get(s.font, plain).total, many):
        seq += 1
        if not op:
            facts = several(args)
            if facts["text"]:
                yield Event("texts", seq, s, facts, tuple(marks))
            seq += len(args) - 1
            continue
        if op == "TJ":  # by far the most frequent one
            if shows == "said":
                if args and isinstance(args[-1], list):
                    yield Event("text", seq, s, said(args[-1]), tuple(marks))
            elif args and isinstance(args[-1], list):
                yield Event("text", seq, s, shown(args[-1]), tuple(marks))
            continue
        if op == "EMC":
            marks = marks[:-1]
            continue
        num = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if op == "Tm":
            if len(num) == 6:
                tm = tlm = tuple(num)
            continue
        names = [str(a) for a in args if isinstance(a, Name)]
        event: tuple[str, dict] | None = None
        # state
        if op == "q":
            saved.append(s)
        elif op == "Q":
            s = saved.pop() if saved else s
        elif op == "cm" and len(num) == 6:
            s = replace(s, ctm=multiply(tuple(num), s.ctm))
        elif op in _PLAIN and num:
            s = replace(s, **{_PLAIN[op]: int(num[0]) if op in ("J", "j", "Tr") else num[0]})
        elif op == "Tz" and num:
            s = replace(s, scale=num[0] / 100)
        elif op == "d" and args and isinstance(args[0], list):
            s = replace(s, dash=(tuple(x for x in args[0] if isinstance(x, (int, float))), num[-1] if num else 0.0))
        elif op == "ri" and names:
            s = replace(s, intent=names[0])
        elif op == "gs" and names:
            s = replace(s, named=names[0])
        # colour
        elif op in _DEVICE and len(num) == _DEVICE[op][2]:
            s = replace(s, **{_DEVICE[op][0]: (_DEVICE[op][1], *num)})
        elif op in ("cs", "CS") and names:
            s = replace(s, **{"fill" if op == "cs" else "stroke": (names[0], *([0.0] * {"DeviceRGB": 3, "DeviceCMYK": 4}.get(names[0], 1)))})
        elif op in ("sc", "scn", "SC", "SCN") and (num or names):
            which = "fill" if op[0] == "s" else "stroke"
            s = replace(s, **{which: (getattr(s, which)[0], *num, *names[-1:])})
        # path
        elif op in ("m", "l") and len(num) == 2:
            at = (num[0], num[1])
            begin = at if op == "m" else begin
            path.append((op, at))
        elif op in ("c", "v", "y") and len(num) == (6 if op == "c" else 4):
            points = list(zip(num[0::2], num[1::2]))
            points = points if op == "c" else [at, *points] if op == "v" else [*points, points[-1]]
            at = points[-1]
            path.append(("c", *points))
        elif op == "h":
            at = begin
            path.append(("h",))
        elif op == "re" and len(num) == 4:
            x, y, w, h = num
            at = begin = (x, y)
            path += [("m", (x, y)), ("l", (x + w, y)), ("l", (x + w, y + h)), ("l", (x, y + h)), ("h",)]
        elif op in ("W", "W*"):
            clip = "nonzero" if op == "W" else "evenodd"
        elif op in _PAINT:
            closed, rule, stroked = _PAINT[op]
            if closed and path:
                path.append(("h",))
            points = [apply(s.ctm, *p) for seg in path for p in seg[1:]]
            box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)] if points else [0.0] * 4
            event = "path", {"op": op, "rule": rule, "stroked": bool(stroked), "clip": clip, "segments": "".join(seg[0] for seg in path), "box": box}
            if clip and path:
                s = replace(s, clip=s.clip + 1)
            path, clip = [], ""
        elif op == "sh" and names:
            event = "shading", {"name": names[0]}
        elif op == "Do" and names:
            event = "object", {"name": names[0], "box": [*apply(s.ctm, 0, 0), *apply(s.ctm, 1, 1)]}
        elif op == "EI":
            event = "image", {"bytes": len(args[0]) if args else 0, "box": [*apply(s.ctm, 0, 0), *apply(s.ctm, 1, 1)]}
        # text
        elif op == "BT":
            tm = tlm = ONE
        elif op == "Tf" and names and num:
            s = replace(s, font=names[0], size=num[-1])
        elif op in ("Td", "TD") and len(num) == 2:
            s = replace(s, leading=-num[1]) if op == "TD" else s
            move(*num)
        elif op == "T*":
            move(0.0, -s.leading)
        elif op in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            if op == '"' and len(num) >= 2:
                s = replace(s, word=num[0], char=num[1])
            if op != "Tj":
                move(0.0, -s.leading)
            event = "text", shown([args[-1]])
        # marked content
        elif op == "BMC" and names:
            marks.append((names[-1], None, seq))
        elif op in ("BDC", "DP") and names:
            found = args[-1] if isinstance(args[-1], dict) else properties.get(names[-1]) if len(names) > 1 else None
            if found is not None and op == "BDC":
                marks.append((names[0], found.get("MCID"), seq))
            elif found is not None:
                event = "point", {"name": names[0], "mcid": found.get("MCID")}
        elif op == "MP" and names:
            event = "point", {"name": names[0], "mcid": None}
        if event:
            yield Event(event[0], seq, s, event[1], tuple(marks))


def spelled(args: list[Any]) -> str:
    """Operands as text, in a file's own syntax."""
    return b" ".join(map(dump, args)).decode("latin-1")
