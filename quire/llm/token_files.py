"""Operator 2, token output: Arrow files of fixed-size sequences and masks.

A shard is an Arrow IPC file whose record batches hold ``BATCH`` rows each: a
fixed-size list of token ids and one of mask bits, so sequence i of a memory-mapped
shard is row i % BATCH of batch i // BATCH, found and read without a copy
(``ShardReader.mask`` for the mask: as numpy booleans its bits are unpacked). Beside it
lies an index file with the documents of the shard in order. Documents follow one
another without regard to sequence ends; the last sequence is filled with zeros whose
mask is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.common import in_batches, shared_dir, table

#: Ids in a sequence, and sequences in a record batch.
LENGTH, BATCH = 1024, 256
#: The id that ends a document.
END = 0


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; the files appear under their names only once they are whole."""

    def __init__(self, uri: str, shard: int, dtype: np.dtype, length: int):
        self.fs, self.root = _open(uri)
        self.name, self.tag = f"{self.root}/shard-{shard:06d}", uuid.uuid4().hex
        self.fs.create_dir(self.root, recursive=True)
        self.length, self.dtype, self.held, self.held_n = length, dtype, [], 0
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], metadata={"length": str(length), "batch": str(BATCH)})
        self.index_schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.out = self.fs.open_output_stream(f"{self.name}.{self.tag}")
        self.index_out = self.fs.open_output_stream(f"{self.name}.{self.tag}.index")
        self.data, self.index = pa.ipc.new_file(self.out, self.schema), pa.ipc.new_file(self.index_out, self.index_schema)
        self.tokens = self.docs = 0

    def add(self, docs: list[int | None], ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        start = self.tokens + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([pa.array(docs, pa.int64()), pa.array(start), pa.array(n)], schema=self.index_schema))
        self.docs += len(docs)
        self.tokens += int(n.sum())
        self.held += ids
        self.held_n += int(n.sum())
        if self.held_n >= self.length * BATCH:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        step, at = self.length * BATCH, 0
        while len(flat) - at >= step or (last and at < len(flat)):
            part = flat[at : at + step]
            at += len(part)
            mask = np.ones(len(part), bool)
            if short := -len(part) % self.length:
                part, mask = np.concatenate((part, np.zeros(short, self.dtype))), np.concatenate((mask, np.zeros(short, bool)))
            self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)], schema=self.schema))
        self.held, self.held_n = [flat[at:]], len(flat) - at

    def close(self) -> tuple[int, int]:
        self._flush(last=True)
        self.data.close(), self.index.close(), self.out.close(), self.index_out.close()
        self.fs.move(f"{self.name}.{self.tag}.index", f"{self.name}.index")
        self.fs.move(f"{self.name}.{self.tag}", f"{self.name}.arrow")
        return self.docs, self.tokens


class ShardReader:
    """Random access to a shard: ``sequence(i)`` is a view where the file is on this machine."""

    def __init__(self, uri: str, shard: int):
        fs, root = _open(uri)
        name = f"{root}/shard-{shard:06d}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.index = pa.ipc.open_file(pa.memory_map(f"{name}.index") if local else fs.open_input_file(f"{name}.index"))
        self.length, self.batch = (int(self.file.schema.metadata[k]) for k in (b"length", b"batch"))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view) and the mask (unpacked from a view of its bits) of sequence i."""
        b, k = self.file.get_batch(i // self.batch), (i % self.batch) * self.length
        ids, mask = (c.flatten().slice(k, self.length) for c in b.columns)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def mask(self, i: int) -> pa.BooleanArray:
        """The mask of sequence i as a view of its bits, without a copy."""
        b, k = self.file.get_batch(i // self.batch), (i % self.batch) * self.length
        return b.column(1).flatten().slice(k, self.length)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, its start in this shard, its ids), one batch in memory at a time."""
        step, have, at, begin = self.length * self.batch, np.zeros(0, np.uint16), 0, 0
        for k in range(self.index.num_record_batches):
            for doc, start, n in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns), strict=True):
                if begin + len(have) < start + n:
                    parts = [have[max(0, start - begin) :]]
                    begin += len(have) - len(parts[0])
                    while begin + sum(map(len, parts)) < start + n:
                        parts.append(self.file.get_batch(at // step).column(0).flatten().to_numpy())
                        at += step
                    have = np.concatenate(parts)
                yield doc, start, have[start - begin : start - begin + n]


def write(df: DataFrame, id_col: str, text_col: str, uri: str, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Encode every text and write shards below ``uri``; (shard, docs, tokens) of each.

    Documents are dealt by ranges of their id and sorted, so the shards in order hold
    them in ascending order (null ids first; rows with the same id next to each other,
    in no set order). A null text is an empty one: its only id is the end id. The job
    runs at once; its result has a row for each shard. An empty table writes nothing.
    """
    path = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, out = tokens.encoder(path), TaskContext.get().partitionId(), None
        end = np.array([END], enc.dtype)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = out or ShardWriter(uri, shard, enc.dtype, length)
                out.add(part.column(0).to_pylist(), [np.concatenate((np.frombuffer(x, enc.dtype), end)) for x in enc.many(part.column(1).to_pylist())])
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "docs", "tokens"), (shard, *out.close()), strict=True))])

    ordered = df.select(F.col(id_col).cast("long"), text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    made = ordered.transform(in_batches, run, "shard long, docs long, tokens long", path).collect()  # a row for each shard file
    return df.sparkSession.createDataFrame([tuple(r) for r in sorted(made)], "shard long, docs long, tokens long")


def read(spark: SparkSession, shards: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start counts over all shards.

    ``ids`` is binary, little-endian unsigned 32-bit. A task reads whole shards.
    """
    rows, base = [], 0
    for r in sorted(map(tuple, shards.collect())):
        rows.append((r[0], base))
        base += r[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, size = [], 0
                for doc, start, ids in ShardReader(uri, shard).documents():
                    held.append((doc, first + start, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 1 << 23:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    todo = spark.createDataFrame(rows, "shard long, first long")
    return (todo.repartition(len(rows)) if rows else todo).transform(in_batches, run, "doc_id long, start long, n_tokens long, ids binary", "*")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*held, strict=True))
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def op2(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    uri = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write(table(spark, sf_dir, "documents"), "doc_id", "text", uri, vocabulary or tokens.vocabulary("byte_bpe_50k.json"))
    return read(spark, shards, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
