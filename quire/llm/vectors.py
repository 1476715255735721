"""What the vector operators share: whole-number vectors, blocks of rows, query blocks against all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_batches

#: Rows, and components, of a block of candidates, at most (one row may have more components).
BLOCK_ROWS, BLOCK_COMPONENTS = 2048, 1 << 18
#: Queries of a query block, at most.
QUERY_ROWS = 256
#: Partitions that a join of blocks is dealt to, at most; more blocks share them.
MOST_CELLS = 20_000


def taking_part(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """(id, vector as doubles, further columns) of the rows with an id and a vector whose components are all there and finite."""
    v = F.col(vector_col).cast("array<double>")
    inf = F.lit(float("inf"))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < inf))).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), *[c.alias(k) for k, c in more.items()])


def whole_numbers(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of all vectors in a row, and where each vector starts (one more than vectors)."""
    starts = column.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.float64, copy=False))
    if len(flat) and not np.abs(flat).max() < 2.0**62:
        raise OverflowError("a scaled component doesn't fit 64 bits")
    return flat.astype(np.int64), starts - starts[0]


def fits(bits: int, a: np.ndarray, b: np.ndarray, terms: int) -> bool:
    """Whether sums of ``terms`` products of components of a and b stay below 2**bits."""
    largest = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    return largest[0] * largest[1] * max(terms, 1) < 1 << bits


def packed(a: np.ndarray) -> bytes:
    """A whole-number array in the least of 1, 2, 4 and 8 bytes an entry; the type's letter comes last. Floats stay doubles."""
    if a.dtype != np.float64:
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        a = a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    return a.tobytes() + a.dtype.char.encode()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(memoryview(data)[:-1], chr(data[-1]))


def in_blocks(df: DataFrame, scale: float, rows: int, make: Callable[..., dict[str, np.ndarray]], names: list[str], components: int = BLOCK_COMPONENTS) -> DataFrame:
    """One row a block: ``block`` (a number of its own) and ``make``'s arrays, packed.

    ``make`` gets the block's columns but the vectors as whole-number arrays, then the
    vectors (all components in a row, and starts). Blocks are made of a task's own rows as
    they come, so nothing is shuffled and no key can be hot; a block is bounded by rows
    and by components.
    """
    kept = [c for c in df.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        n = size = 0

        def block() -> pa.RecordBatch:
            columns = [np.concatenate([h[0][k] for h in held]) for k in range(len(kept))]
            flat = np.concatenate([h[1] for h in held])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            out = make(*columns, flat, starts)
            return pa.record_batch([pa.array([number], pa.int64()), *[pa.array([packed(out[x])], pa.binary()) for x in names]], names=["block", *names])

        for b in batches:
            flat, starts = whole_numbers(b.column(b.schema.get_field_index("vector")), scale)
            columns = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in kept]
            at = 0
            while at < b.num_rows:
                room = np.searchsorted(starts, starts[at] + components - size, "right") - 1
                to = min(at + rows - n, max(room, at), b.num_rows)
                if to == at and not n:
                    to = at + 1
                if to > at:
                    held.append(([c[at:to] for c in columns], flat[starts[at] : starts[to]], starts[at : to + 1] - starts[at]))
                    n, size = n + to - at, size + int(starts[to] - starts[at])
                    at = to
                if at < b.num_rows:
                    yield block()
                    number += 1
                    held, n, size = [], 0, 0
        if n:
            yield block()

    return df.transform(in_batches, run, "block long, " + ", ".join(f"{x} binary" for x in names))


def meet(blocks: DataFrame, count: int, queries: DataFrame, run: Callable[[dict, dict], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """``run(block, query block)`` for each of the two, as rows of longs.

    Blocks are dealt to cells by their number, query blocks go to every cell, and a join
    on the cell brings them together: each candidate moves once, each query once a cell,
    far less than what their comparison costs. A cell's blocks are unpacked one by one.
    """
    cells = max(1, min(count, MOST_CELLS))
    left = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(cells, "cell")
    mine, theirs = blocks.columns[1:], queries.columns[1:]

    def arrays(b: pa.RecordBatch, columns: list[str], prefix: str, i: int) -> dict[str, np.ndarray]:
        return {c: unpacked(b.column(b.schema.get_field_index(prefix + c))[i].as_py()) for c in columns}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = None, {}
        for b in batches:
            numbers = b.column(b.schema.get_field_index("block")).to_pylist()
            for i, number in enumerate(numbers):
                if number != known:
                    known, block = number, arrays(b, mine, "", i)
                out = run(block, arrays(b, theirs, "q_", i))
                yield pa.record_batch([pa.array(out[x], pa.int64()) for x in names], names=names)

    return left.join(right, "cell").drop("cell", "q_block").transform(in_batches, each, ", ".join(f"{x} long" for x in names))


def first_of(rows: DataFrame, keys: list[str], k: int, score: str, ident: str) -> DataFrame:
    """The k rows of each key with the highest score, ties by smaller id, with ``rank`` from 1. Tasks cut their own rows first."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
