"""Shared pieces of the training-data operators: tables, scratch space, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import small_batches

#: The characters that separate words, fixed by the contracts: space and \x09-\x0D.
WORD_BREAKS = " \t\n\x0b\x0c\r"


#: Batches after which a task returns what it has freed.
TRIM = 16


def give_back() -> None:
    """Return what this process has freed to the machine: workers are kept for the tasks to come, and each would hold its own peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; every so many the memory that they have freed is returned."""
    for n, b in enumerate(batches):
        if n % TRIM == TRIM - 1:
            give_back()
        yield b


#: What this process keeps for the tasks to come, by name.
_KEPT: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """An object that is made once in a Python process; workers are reused, so it outlives a task."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget(but: str | None = None) -> None:
    """Let go of all objects of ``held`` but one."""
    for name in [n for n in _KEPT if n != but]:
        del _KEPT[name]


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` over batches that are bounded by their bytes, too (a setting that the session gives wins).

    ``keeps`` names the object of ``held`` that the tasks use. A worker lets go of all others, as
    it may have run another operator's tasks before, whose object would add to these tasks' own peak
    (``*``: of none, for tasks that need little memory themselves).
    """
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keeps != "*":
            forget(keeps)
        try:
            yield from run(trimmed(batches))
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a final slash.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset in local mode
    (tests, one machine) a folder of this machine is set once for the session; elsewhere
    that is an error, as executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Written tables that cut the lineage of a multi-job operator.

    ``keep`` writes a DataFrame as Parquet below the shared folder and reads it
    back, so a lost executor costs at most the job that was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        # the job's shuffle files go once the driver notices that nothing refers to them; it may as well do so now
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables no longer read, to give their disk back early."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# 64-bit hashing of many words at once ---------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POW[0]) < n:
        m = max(n, 1 << 16)
        for k, b in ((0, _P), (1, _INV)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WORD_BREAKS]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a UTF-8 text, and where its words start and end."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        z = np.zeros(0, np.int64)
        return b, z, z
    w = ~_SPACE[b]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if w[0]:
        edge = np.concatenate(([0], edge))
    if w[-1]:
        edge = np.concatenate((edge, [len(b)]))
    return b, edge[0::2], edge[1::2]


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased if ``fold``.

    Prefix sums of byte * base**position give every word's polynomial hash in a
    few passes over the text; the length and a finaliser then spread the bits.
    """
    b, s, e = word_bounds(data)
    if not len(s):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(b) + 1)
    v = (_FOLD[b] if fold else b.astype(np.uint64)) + np.uint64(1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(v * p[:-1], out=c[1:])
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    Fewer than k words: the whole sequence is the one shingle. No word: none.
    """
    h = word_hashes(data)
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = mix(x * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n])
    return np.unique(x)
