"""Incremental updates as a stream: the newest version of each object, kept as state, and what changes with each batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Keeps (at, ord, deleted, digest) of a key's newest version.

    A batch's versions of a key come in any order and in several parts; only the newest
    counts, and only if it is newer than the state's. What is deleted stays as a tombstone, so that
    a late version can't bring it back, until the watermark is ``keep`` milliseconds past it; then it is forgotten.
    """

    def __init__(self, keys: list[str], keep: int):
        self.keys, self.keep = keys, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("at", T.TimestampType()), T.StructField("ord", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("digest", T.StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # at once, not as a generator: the state is that of the key for which this is called
        top = None
        for part in rows:
            k = np.lexsort((part["ord"].to_numpy(), part["at"].to_numpy()))[-1] if len(part) > 1 else 0
            best = part["at"].iat[k], int(part["ord"].iat[k])
            if top is None or best > top[:2]:
                top = (*best, bool(part["deleted"].iat[k]), part["digest"].iat[k])
        if top is None:
            return iter(())
        was = self.newest.get()  # None if there is none
        if was is not None and (pd.Timestamp(was[0]), was[1]) >= (pd.Timestamp(top[0]), top[1]):
            return iter(())
        if was is not None and was[2]:  # only a tombstone has a timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.newest.update((pd.Timestamp(top[0]).to_pydatetime(), *top[1:]))
        if top[2]:
            self.handle.registerTimer(max(int(pd.Timestamp(top[0]).tz_localize("UTC").timestamp() * 1000) + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        there = was is not None and not was[2]
        change = ("removed" if top[2] else "modified" if was[3] != top[3] else None) if there else None if top[2] else "added"
        row = {k: [v] for k, v in zip(self.keys, key, strict=True)} | {"at": [top[0]], "ord": [top[1]], "change": [change]}
        return iter([pd.DataFrame(row)] if change else ())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self.newest.get()[2]:
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(versions: DataFrame, keys: list[str], content: list[str], at: str, order: str, deleted: str, late: str = "1 hour", keep: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """(keys, at, ord, change) for a stream of versions: each key's "added", "removed" or "modified", at most one a batch.

    A version is newer by ``at``, then by ``order``; it is modified if the hash of its
    ``content`` is another one. Versions that lie behind the watermark by more than ``late`` may
    be dropped; a version that is older than a key's newest changes nothing. Rows without
    time or order go. State is a row a key that is there, and a tombstone for ``keep``
    milliseconds where it isn't any more. The session's state store is set to one that
    holds such state, if it is the usual one.
    """
    conf = versions.sparkSession.conf
    if conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKS)
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias("digest")
    rows = versions.select(*keys, F.col(at).cast("timestamp").alias("at"), F.col(order).cast("long").alias("ord"), F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"), digest)
    rows = rows.where("at IS NOT NULL AND ord IS NOT NULL").withWatermark("at", late)
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("at", T.TimestampType()), T.StructField("ord", T.LongType()), T.StructField("change", T.StringType())])
    return rows.groupBy(*keys).transformWithStateInPandas(Newest(keys, keep), out, "Update", "EventTime")


def follow(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Run a stream over what has come since its checkpoint, each batch into a folder of its own below ``out``.

    A batch that is repeated after a failure replaces its folder, so none counts twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
