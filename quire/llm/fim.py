"""Operator 11, fill-in-middle: a text's lines rearranged around two cuts, on a rope."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import in_batches, table

#: Code points of a fresh leaf, at most. Leaves are cut anywhere, so a text without line ends has small leaves, too.
LEAF = 4096
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Rope:
    """An immutable binary tree over a text. A leaf holds a stretch; every node caches the
    line ends (``ends``) and code points (``chars``) below it.

    A unit is a line with its line end, or what follows the last line end. A unit's rank
    is known to the leaf that holds its end, so counts add up wherever leaves are cut.
    """

    __slots__ = ("text", "left", "right", "ends", "chars")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.ends, self.chars = text.count("\n"), len(text)
        else:
            self.ends, self.chars = left.ends + right.ends, left.chars + right.chars

    @staticmethod
    def of(text: str, leaf: int = LEAF) -> Rope:
        """A balanced rope: leaves side by side, paired level by level."""
        level = [Rope(text[i : i + leaf]) for i in range(0, len(text), leaf)] or [Rope("")]
        while len(level) > 1:
            pairs = [Rope(None, *level[i : i + 2]) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[2 * len(pairs) :]
        return level[0]

    def __add__(self, other: Rope) -> Rope:
        """Both, one after the other; nothing is copied."""
        return other if not self.chars else self if not other.chars else Rope(None, self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.text is not None:
                out.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(out)

    def ends_open(self) -> bool:
        """Whether the last unit has no line end."""
        node = self
        while node.text is None:
            node = node.right if node.right.chars else node.left
        return bool(node.text) and node.text[-1] != "\n"

    def units(self) -> int:
        return self.ends + self.ends_open()

    def _split(self, rank: int, by_units: bool) -> tuple[Rope, Rope]:
        """Down one path to the leaf that holds the place, and back up with the two sides."""
        path, node = [], self
        while node.text is None:
            here = node.left.ends if by_units else node.left.chars
            goes_left = rank <= here
            path.append((node, goes_left))
            if not goes_left:
                rank -= here
            node = node.left if goes_left else node.right
        if by_units:
            at = 0
            for _ in range(rank):
                at = node.text.index("\n", at) + 1
        else:
            at = rank
        before, after = Rope(node.text[:at]), Rope(node.text[at:])
        for node, goes_left in reversed(path):
            if goes_left:
                after = after + node.right
            else:
                before = node.left + before
        return before, after

    def after_units(self, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units, and the rest."""
        return (self, Rope("")) if rank > self.ends else self._split(rank, True)

    def after_chars(self, rank: int) -> tuple[Rope, Rope]:
        return self._split(min(rank, self.chars), False)


def rearrange(text: Rope, low: int, high: int, form: str) -> tuple[Rope, int, int]:
    """Cut after ``low`` and after ``high`` units and put the three parts together in the
    order of ``form`` (psm or spm); also the code points of prefix and middle."""
    prefix, rest = text.after_units(low)
    middle, suffix = rest.after_units(high - low)
    parts = [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
    if form == "spm":
        parts[:2] = reversed(parts[:2])
    out = Rope("")
    for mark, part in parts:
        out = out + Rope(mark) + part
    return out, prefix.chars, middle.chars


def invert(output: str, form: str) -> Rope:
    """The text that ``rearrange`` had, from its output and form alone.

    A text that holds a sentinel stays plain, and no sentinel can arise across the border
    of a part and another sentinel, so each is found where it was put.
    """
    rope = Rope.of(output)
    if form == "plain":
        return rope
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second), output.index(MIDDLE)
    rope, middle = rope.after_chars(at[1])
    one, two = rope.after_chars(at[0])
    parts = {first: one.after_chars(len(first))[1], second: two.after_chars(len(second))[1]}
    return parts[PREFIX] + middle.after_chars(len(MIDDLE))[1] + parts[SUFFIX]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four draws of 32 bits that a document's id and the seed decide."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(df: DataFrame, id_col: str, text_col: str, percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` counts the text's lines. Of the texts that aren't empty and hold no sentinel,
    ``percent`` in a hundred are cut after two numbers of lines, both drawn from 0 to n,
    and rearranged: as suffix, prefix, middle for ``spm_percent`` in a hundred, else as
    prefix, suffix, middle. The others stay plain, with null counts of characters.

    A null text is an empty one. Draws depend on the id alone, so rows that share an id
    share them, and rows without an id draw as "null". Other columns are left out; an
    empty table gives an empty result. Nothing is shuffled; a task holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rope, drawn = Rope.of(text or ""), draws(doc, seed)
                n = rope.units()
                if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= percent:
                    rows.append((doc, n, "plain", None, None, text or ""))
                    continue
                low, high = sorted(x % (n + 1) for x in drawn[:2])
                form = "spm" if drawn[3] % 100 < spm_percent else "psm"
                out, prefix, middle = rearrange(rope, low, high, form)
                rows.append((doc, n, form, prefix, middle, str(out)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.transform(in_batches, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The rows with ``restored``, the text before ``transform``, made of form and output
    alone (a column of that name is replaced). A null output or form restores null."""
    df = df.drop("restored")
    at = [df.columns.index(form_col), df.columns.index(output_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if f is None or x is None else str(invert(x, f)) for f, x in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "restored"])

    return df.transform(in_batches, run, df.select("*", F.lit(None).cast("string").alias("restored")).schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents"), "doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
),
drawn AS (
  SELECT *, len(lines) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM cut
),
formed AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS p, coalesce(array_to_string(lines[a + 1:b], ''), '') AS m, coalesce(array_to_string(lines[b + 1:n], ''), '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
