"""The stateful stream of versions against a batch, over several runs from one checkpoint."""

import datetime as dt
import random

import pytest

from quire.operators import multidoc
from quire.streaming import updates

SCHEMA = "doc int, num int, at timestamp, v long, gone boolean, text string"


def minute(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


@pytest.fixture
def runs(spark, tmp_path):
    def put(rows, keep=10**9):
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        updates.follow(updates.changes(stream, ["doc", "num"], ["text"], "at", "v", "gone", keep=keep), f"{tmp_path}/state", f"{tmp_path}/out")
        return sorted((r.doc, r.num, r.ord, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    return put


def test_changes_between_runs(runs):
    first = runs([(1, 1, minute(1), 1, False, "a"), (1, 1, minute(2), 2, False, "b"), (1, 2, minute(1), 1, True, "x"), (1, 3, minute(5), 1, None, "k"), (1, 4, minute(5), 1, False, None), (1, 5, None, 1, False, "no time")])
    assert first == [(1, 1, 2, "added"), (1, 3, 1, "added"), (1, 4, 1, "added")]
    second = runs([(1, 1, minute(2), 3, False, "b"), (1, 3, minute(6), 2, True, "k"), (1, 2, minute(0), 0, False, "older than its deletion"), (2, 1, minute(9), 1, False, "n"), (1, 4, minute(6), 2, False, "t")])
    assert sorted(set(second) - set(first)) == [(1, 3, 2, "removed"), (1, 4, 2, "modified"), (2, 1, 1, "added")]
    assert sorted(set(runs([(1, 3, minute(7), 3, False, "k")])) - set(second)) == [(1, 3, 3, "added")]


def test_a_tombstone_is_forgotten_behind_the_watermark(runs):
    runs([(1, 1, minute(0), 1, True, "x")], keep=1000)
    runs([(9, 9, minute(600), 1, False, "moves the watermark")], keep=1000)
    assert (1, 1, 1, "added") not in runs([(1, 1, minute(0), 0, False, "behind the watermark")], keep=1000)
    assert (1, 1, 7, "added") in runs([(1, 1, minute(601), 7, False, "back")], keep=1000)


def test_the_stream_equals_the_batch(spark, runs):
    """The second run's changes are those between two snapshots, as the batch has them."""
    rng = random.Random(8)
    old = {(d, n): f"t{rng.randrange(3)}" for d in range(4) for n in range(25) if rng.random() < 0.7}
    new = {(d, n): f"t{rng.randrange(3)}" for d in range(4) for n in range(25) if rng.random() < 0.7}
    first = runs([(*k, minute(1), 1, False, t) for k, t in old.items()])
    both = runs([(*k, minute(2), 2, k not in new, new.get(k)) for k in {*old, *new}])
    a, b = (spark.createDataFrame([(*k, t) for k, t in s.items()], "doc int, num int, text string") for s in (old, new))
    want = sorted((r.doc, r.num, 2, r.change) for r in multidoc.changed(a, b, ["doc", "num"]).collect())
    assert [r for r in both if r[2] == 2] == want and len(first) == len(old)


def test_few_calls_for_the_state():
    """A key that is there takes one read and one write; its versions may come in any order."""
    import pandas as pd

    from quire.streaming.updates import Newest

    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def listTimers(self):
            calls.append("timers")
            return iter(())

    p = Newest(["k"], 1000)
    p.handle, p.newest = Handle(), State()
    day = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"at": [day, day, day - pd.Timedelta("1D")], "ord": [1, 3, 9], "deleted": [False] * 3, "digest": ["a", "b", "c"]})
    out = list(p.handleInputRows((1,), iter([rows, rows[:1]]), None))
    assert [(x["ord"][0], x["change"][0]) for x in out] == [(3, "added")] and p.newest.value[1:] == (3, False, "b")
    assert list(p.handleInputRows((1,), iter([rows]), None)) == []
    assert calls == ["get", "update", "get"]
