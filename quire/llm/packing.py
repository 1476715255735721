"""Operator 3, packing: sequences of equal capacity and balanced attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.common import in_batches, table

CAPACITY, END = 1024, 0
#: Tokens that a task packs together, about; bounds its memory whatever the texts' lengths.
BLOCK = 1 << 22
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Rows and bytes of an outgoing batch, at most (one row may be larger).
OUT_ROWS, OUT_BYTES = 8192, 4 << 20


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Place pieces of at most ``capacity`` into ceil(total / capacity) sequences: (piece, from, length, sequence, offset).

    Longest first (ties: in the given order), each goes to the sequence of lowest cost
    (ties: the first) among all that have room for it. If none has, the sequence of
    lowest cost that isn't full takes what it can hold, and the rest takes its turn among
    the pieces of its length, behind them. The sequences hold just enough, so all but the
    last free tokens of a block are used.

    Lengths only fall, so a sequence with room for one piece has room for the next until
    it takes one; one without is set aside under its free room and comes back when the
    lengths have fallen that far. ``open`` thus holds the sequences with room and no
    other, and its least is the exact choice.
    """
    out: list[tuple[int, int, int, int, int]] = []
    count = -(-sum(lengths) // capacity)
    free, cost = [capacity] * count, [0.0] * count
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for piece, n in enumerate(lengths):
        waiting[n].append((piece, 0))
    room = [(0.0, s) for s in range(count)]  # equal costs in order: a heap
    aside: list[list[int]] = [[] for _ in range(capacity + 1)]
    all_aside: list[tuple[float, int]] = []
    for n in range(capacity, 0, -1):
        for s in aside[n]:
            if free[s] == n:
                heapq.heappush(room, (cost[s], s))
        aside[n] = []
        added = linear * n + quadratic * n * n
        for piece, at in waiting[n]:
            if room:
                c, s = heapq.heappop(room)
                out.append((piece, at, n, s, capacity - free[s]))
                free[s] -= n
                cost[s] = c + added
                if free[s] >= n:
                    heapq.heappush(room, (cost[s], s))
                elif free[s]:
                    aside[free[s]].append(s)
                    heapq.heappush(all_aside, (cost[s], s))
                continue
            # all sequences are full or aside here; entries of those that have come back since have another cost or no room
            while True:
                c, s = heapq.heappop(all_aside)
                if free[s] and cost[s] == c:
                    break
            m = free[s]
            out.append((piece, at, m, s, capacity - m))
            free[s] = 0
            waiting[n - m].append((piece, at + m))
    return out


def pack(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Each text is encoded and ended with the end id; a null text is an empty one, so every
    row has a piece. A document longer than the capacity is first cut into full pieces and
    a rest. A task packs its own rows, in blocks of about ``block`` tokens (a longer
    document is a block with its neighbours), so nothing is shuffled, equal or null ids
    are no hot group, and memory is bounded by the block and the longest text. Sequences
    never cross blocks; a block's padding is less than one sequence. ``sequence_id`` is
    partition * 2**32 + the sequence in the partition: which rows share a sequence
    depends on how the table is split, the ids of a document don't. Rows that share an id
    are packed each; other columns are left out; an empty table gives an empty result.
    """
    path = vocabulary

    def place(docs: list[tuple[int | None, bytes]], width: int, first: int) -> Iterator[pa.RecordBatch]:
        pieces = [(i, at, min(capacity, len(x) // width - at)) for i, (_, x) in enumerate(docs) for at in range(0, len(x) // width, capacity)]
        cols: list[list] = [[] for _ in range(7)]

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for c in cols:
                c.clear()
            return out

        size = 0
        for p, at, n, s, offset in assign([x[2] for x in pieces], capacity):
            i, begin, _ = pieces[p]
            doc, data = docs[i]
            part = np.frombuffer(data, f"<u{width}", n, (begin + at) * width).astype("<u4").tobytes()
            for c, v in zip(cols, (doc, begin + at, n, part, len(data) // width, first + s, offset), strict=True):
                c.append(v)
            size += len(part)
            if len(cols[0]) >= OUT_ROWS or size >= OUT_BYTES:
                yield batch()
                size = 0
        if cols[0]:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.array([END], enc.dtype).tobytes()
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.many(b.column(1).to_pylist()), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // enc.width + 1
                if size >= block:
                    yield from place(held, enc.width, first)
                    first += -(-size // capacity)
                    held, size = [], 0
        if held:
            yield from place(held, enc.width, first)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.transform(in_batches, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", path)


def op3(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary or tokens.vocabulary("byte_bpe_50k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
