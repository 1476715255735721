"""Operator 5, quality rules: per-text counts, and lines that recur across a host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import WORD_BREAKS, Scratch, in_batches, table

#: A line is above the limit in more than LEAST documents and more than a SHARE of its host's, or in more than MANY whatever their share.
LEAST, SHARE, MANY = 10, 0.05, 1000
#: Lines above the limits that are broadcast as hashes (8 bytes each); of more than that a table is joined.
BROADCAST = 1 << 18
#: A document that loses more than this share of its words is depleted.
LOSS = 0.5

_SYMBOLS = "#*$%&|<>"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, print binary, lines array<long>, line_words array<int>"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in some 5-word window found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit[i] += 1
            hit[i + 5 if i + 5 <= len(words) else len(words)] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(_FOLD)) - (1 << 63)


def counts(text: str | None) -> tuple:
    """The columns of ``_STATS`` for one text; a null text counts as an empty one.

    ``lines`` has a hash for each line, normalised (A-Z lower-cased, digits as 0, white
    space as single spaces), or null for a line without a word.
    """
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = data.split(b"\n")
    with_words = [x.split() for x in lines]
    seen, dup = set(), 0
    for line, w in zip(lines, with_words, strict=True):
        if w:
            dup += line in seen
            seen.add(line)
    hashes = [line_hash(w) if w else None for w in with_words]
    return (
        len(words),
        len(text) - sum(map(text.count, WORD_BREAKS)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeat_words(words),
        xxhash.xxh3_128_digest(data),
        hashes,
        [len(w) for w in with_words],
    )


def _key(host: str, line: int) -> int:
    """One hash of a host and a line's hash."""
    return xxhash.xxh3_64_intdigest(host, line & ((1 << 64) - 1))


def _count_all(base: DataFrame, often: Broadcast | None = None) -> DataFrame:
    """(row, host, text) with the counts in place of the text, and with ``removed`` if the lines above the limits are given."""
    stats = T._parse_datatype_string(_STATS + (", removed array<long>" if often else ""))
    types = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    kinds = [types[f.dataType.simpleString()] for f in stats.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = often.value if often else frozenset()
        for b in batches:
            rows = [counts(t) for t in b.column(2).to_pylist()]
            if often:
                rows = [(*r, [x for x in set(r[6]) if x is not None and _key(h, x) in above]) for h, r in zip(b.column(1).to_pylist(), rows, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([*b.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["row", "host", *stats.names])

    return base.transform(in_batches, run, T.StructType([base.schema["row"], base.schema["host"], *stats.fields]))


def _lines_only(base: DataFrame) -> DataFrame:
    """(host, print, lines): the part of the counts that a host's lines are counted by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            lines = [[line_hash(w) for x in t.split(b"\n") if (w := x.split())] for t in texts]
            yield pa.record_batch([b.column(0), pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary()), pa.array(lines, pa.list_(pa.int64()))], names=["host", "print", "lines"])

    return base.select("host", "text").transform(in_batches, run, "host string, print binary, lines array<long>")


def judge(df: DataFrame, text_col: str, host_col: str, carry: list[str], least: int = LEAST, share: float = SHARE, loss: float = LOSS, many: int | None = MANY) -> DataFrame:
    """``carry`` of every row, its counts, ``base_failed``, ``removed`` (hashes of the lines
    above the limits), ``lost_words`` and ``kept``.

    A host's documents are its distinct texts, so copies of one text neither count for
    its lines nor differ in their verdict. For each host and normalised line the
    documents that have it are counted; a line in more than ``least`` of them and in more
    than ``share`` of the host's goes, as does one in more than ``many`` of them whatever
    their share, so that the limit doesn't rise with a host without end. A document that
    loses more than ``loss`` of its words is rejected, as is one that fails the base rules.
    A null host is a host. Null and empty texts have no words and fail. Every row of the
    input gives one row, repeated rows alike; an empty table gives an empty result.
    Carried columns with the name of a count or a verdict are replaced, others of any
    name pass through.

    Texts are reduced to numbers where they are read, once if ``carry`` leaves the text
    out, else once for their lines and once for the rest. Only line hashes are shuffled,
    summed up per task before. The hot host is no single group anywhere: its lines are
    dealt by (host, line) and its documents by (host, text). Where texts are carried, the
    lines above the limits are broadcast if they are few (``BROADCAST``), so that no text
    is shuffled; else the documents' own lines among them are joined.
    """
    made = [*T._parse_datatype_string(_STATS).names, "base_failed", "removed", "lost_words", "kept"]
    kept = [c for c in carry if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")
    host = F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit("null"))
    base = df.select(row.alias("row"), host.alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scratch = Scratch(df.sparkSession, "lines")
    texts_too = text_col in kept
    hashed = scratch.keep(_lines_only(base) if texts_too else _count_all(base), "hashed")
    texts = hashed.groupBy("host", "print").agg(F.first("lines").alias("lines"))
    size = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = texts.select("host", "print", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("in")).where(F.col("in") > least)
    limit = share * F.col("docs") if many is None else F.least(share * F.col("docs"), F.lit(float(many)))
    often = scratch.keep(often.join(size, "host").where(F.col("in") > limit).select("host", "line"), "often")
    if texts_too and often.count() <= BROADCAST:
        above = frozenset(_key(h, x) for h, x in zip(*(c.to_pylist() for c in often.toArrow().columns), strict=True))
        out = _count_all(base, df.sparkSession.sparkContext.broadcast(above))
    else:
        removed = lines.join(often, ["host", "line"]).groupBy("host", "print").agg(F.collect_set("line").alias("removed"))
        removed = scratch.keep(removed, "removed")  # as a file its size is known before the join below is planned
        out = (_count_all(base) if texts_too else hashed).join(removed, ["host", "print"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    gone = F.transform(F.arrays_zip("lines", "line_words"), lambda x: F.when(F.array_contains("removed", x["lines"]), x["line_words"]).otherwise(0))
    out = out.withColumn("lost_words", F.when(F.size("removed") > 0, F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= loss * F.col("n_words")))
    return out.select(*(["row.*"] if kept else []), *(c for c in made if c != "print"))


def clean(judged: DataFrame, text_col: str) -> DataFrame:
    """The kept rows with the lines above the limits taken out of their text."""
    rows = judged.where("kept")
    lines = F.arrays_zip(F.split(F.col(text_col), "\n", -1).alias("t"), F.col("lines").alias("h"))
    rest = F.filter(lines, lambda x: x["h"].isNull() | ~F.array_contains("removed", x["h"]))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform(rest, lambda x: x["t"]), "\n")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"), "text", "source", ["doc_id", "source"])
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"'[^\x20\x09-\x0D]+'"
#: Kept columns of ``judge`` in DuckDB's SQL.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, {_WORDS}) AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
grams AS (SELECT rid, p, ws[p:p + 4] AS g FROM pos),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
repeats AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM rep WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
good AS (SELECT *, regexp_extract_all(line, {_WORDS}) AS lw FROM lines WHERE regexp_matches(line, {_WORDS})),
normed AS (SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS norm FROM good),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM good GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT host, norm FROM normed JOIN hosts USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT t) > {LEAST} AND count(DISTINCT t) > least({SHARE} * docs, {MANY})),
lost AS (SELECT rid, sum(len(lw)) AS lost_words FROM normed JOIN often USING (host, norm) GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM d JOIN w USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= {LOSS} * n_words AS kept
FROM s
"""
