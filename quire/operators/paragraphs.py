"""Layout rules that carry state from run to run or from line to line: an ordered fold for each page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Runs whose base lines differ by less share a line; shares of the size or of the space's width (fixed values).
SAME_LINE, DROP, INDENT, WORD_GAP, ALIGNED = 0.1, 2.5, 2.0, 1.5, 0.25
#: What begins a line of a list; both lines must match one of these as a whole (fixed values).
ITEMS = tuple(re.compile(p) for p in (r"\.", r"\d+\.", r"\[\d+\]", r"\d+\)", r"[A-Z]\.", r"[a-z]\.", r"[A-Z]\)", r"[a-z]\)", r"[IVXL]+\.", r"[ivxl]+\."))


class Run(NamedTuple):
    text: str
    x: float
    y: float
    width: float
    height: float
    font_size: float
    space: float = 0.0
    dir: float = 0.0
    seq: int = 0


def compare(a: Run, b: Run) -> int:
    """Reading order: direction, then on one line from left to right, else the higher first.

    Two runs share a line if their base lines are nearly equal or the base line of one
    lies in the height of the other. That relation isn't transitive, so the order of a
    page is that of a stable merge sort, not of a key.
    """
    _, ax, ay, _, ah, _, _, ad, _ = a
    _, bx, by, _, bh, _, _, bd, _ = b
    if ad != bd:
        return -1 if ad < bd else 1
    if abs(ay - by) < SAME_LINE or ay <= by <= ay + ah or by <= ay <= by + bh:
        return (ax > bx) - (ax < bx)
    return (ay < by) - (ay > by)


def reading_order(runs: list[Run]) -> list[Run]:
    return sorted(runs, key=cmp_to_key(compare))


def overlap(y1: float, h1: float, y2: float, h2: float) -> bool:
    return abs(y1 - y2) < SAME_LINE or y2 - h2 <= y1 <= y2 or y1 - h1 <= y2 <= y1


def lines(runs: list[Run]) -> Iterator[list[Run]]:
    """Runs in the given order as lines: a run opens one if it doesn't overlap the span of its line so far."""
    line: list[Run] = []
    top, height = float("-inf"), float("-inf")
    for r in runs:
        y, h = r.y, r.height
        if line and not (abs(y - top) < SAME_LINE or overlap(y, h, top, height)):
            yield line
            line, top, height = [], float("-inf"), float("-inf")
        line.append(r)
        top, height = y if y > top else top, h if h > height else height
    if line:
        yield line


def breaks(line: list[Run], factor: float = WORD_GAP) -> list[bool]:
    """For each run whether a word break stands before it: its gap to the run before exceeds factor * size.

    A run without width is taken to be half its size wide for each character.
    """
    out = [False]
    for a, b in zip(line, line[1:]):
        width = a.width or 0.5 * a.font_size * len(a.text)
        out.append(b.x - (a.x + width) > factor * b.font_size)
    return out[: len(line)]


def item_pattern(text: str) -> re.Pattern | None:
    return next((p for p in ITEMS if p.fullmatch(text)), None)


def paragraphs(starts: list[Run], drop: float = DROP, indent: float = INDENT) -> list[str]:
    """For the first runs of the lines of a page: ``start``, ``hanging`` or empty.

    Each is compared with the line before it: a large step down or to the right begins a
    paragraph, to the right of a paragraph's first line it hangs; an aligned line goes on
    as the one before, or begins one if both are items of one kind of list; a step to the
    left begins one unless the line before did.
    """
    out: list[str] = []
    for k, r in enumerate(starts):
        if not k:
            out.append("start")
            continue
        before, was = starts[k - 1], out[-1]
        space = r.space or 0.25 * r.font_size
        dx, dy = r.x - before.x, abs(r.y - before.y)
        kind = ""
        if dy > drop * r.font_size:
            kind = "start"
        elif dx > indent * space:
            kind = "hanging" if was == "start" else "start"
        elif dx < -space:
            kind = "" if was == "start" else "start"
        elif abs(dx) < ALIGNED * max(r.width / max(len(r.text), 1), space):
            same = item_pattern(before.text)
            kind = "hanging" if was == "hanging" else "start" if was == "start" and same is not None and same is item_pattern(r.text) else ""
        out.append(kind)
    return out


def reconstruct(runs: DataFrame, factor: float = WORD_GAP, drop: float = DROP, indent: float = INDENT, bead: str | None = None) -> DataFrame:
    """doc_id, page_idx, seq, ord, line_no, word_break, paragraph of every run.

    ``runs``: doc_id, page_idx, seq, text, x, y, width, font_size, and where they are known
    height, space and dir; null numbers count as 0. Pages are folded each by itself, with
    ``bead`` each bead of a page by itself, in its order. ``paragraph`` is set on the
    first run of a line.
    """
    has = set(runs.columns)

    def fold(page: pa.Table) -> pa.Table:
        n = page.num_rows
        cols = {c: [float(v or 0) for v in page[c].to_pylist()] if c in has else [0.0] * n for c in ("x", "y", "width", "height", "font_size", "space", "dir")}
        if "height" not in has:
            cols["height"] = [v * 0.7 for v in cols["font_size"]]
        made = map(Run, [t or "" for t in page["text"].to_pylist()], *cols.values(), page["seq"].to_pylist())
        groups: dict = {}
        if bead:
            for key, run in zip(page[bead].to_pylist(), made):
                groups.setdefault(key, []).append(run)
        else:
            groups[0] = list(made)
        doc, idx = page["doc_id"][0].as_py(), page["page_idx"][0].as_py()
        seqs, numbers, gaps, kinds, number = [], [], [], [], 0
        for key in sorted(groups, key=lambda k: (k is None, k or 0)):
            found = list(lines(reading_order(sorted(groups[key], key=itemgetter(-1)))))
            marks = paragraphs([x[0] for x in found], drop, indent)
            for line, mark in zip(found, marks):
                number += 1
                seqs += [run.seq for run in line]
                numbers += [number] * len(line)
                gaps += breaks(line, factor)
                kinds += [mark] + [None] * (len(line) - 1)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(([doc] * n, [idx] * n, seqs, range(1, n + 1), numbers, gaps, kinds), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], names=["doc_id", "page_idx", "seq", "ord", "line_no", "word_break", "paragraph"])

    return runs.groupBy("doc_id", "page_idx").applyInArrow(fold, "doc_id long, page_idx int, seq long, ord int, line_no int, word_break boolean, paragraph string")
