"""Reachability and snapshots over whole tables."""

import pytest

from quire.operators import trees
from quire.plans import catalog


def test_nothing_is_left_out(spark):
    sf = "/root/testdata/sf0.1"
    nodes = sorted(r.node for r in catalog.queries()["resource_reachability"](spark, sf).collect())
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert nodes == [1 << k for k in range(n.bit_length() + 1)]
    got = [r.change for r in catalog.queries()["snapshot_diff"](spark, "/root/testdata/sf0.001").collect()]
    assert set(got) == {"added", "removed", "modified"}


def test_a_limit_is_an_error(spark):
    edges, root = spark.range(6).selectExpr("id AS src", "id + 1 AS dst"), spark.range(1).selectExpr("id AS node")
    assert sorted(r.node for r in trees.reachable(edges, root).collect()) == list(range(7))
    with pytest.raises(RuntimeError):
        trees.reachable(edges, root, limit=3)


def test_texts_of_a_large_table_are_dealt_finely_enough_to_be_sorted_in_memory(spark):
    from quire.session import size_of
    from quire.sources import runs

    assert [size_of(x) for x in ("134217728b", "128MB", "16m", "1g", "7")] == [1 << 27, 1 << 27, 1 << 24, 1 << 30, 7]
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")  # so that a small table has several splits
    try:
        splits = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").rdd.getNumPartitions()
        assert splits > 1 and runs.by_document(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 32 * splits
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_reachable_never_broadcasts_edges(spark):
    """Few nodes go to the edges, many are shuffled with them; a small table of edges isn't sent around either."""
    from quire.operators import trees

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    new = spark.createDataFrame([(0,), (3,)], "node long")
    for n, join in ((2, "BroadcastHashJoin"), (trees.FEW + 1, "SortMergeJoin")):
        got = trees._met(new, n, edges)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "BuildRight" not in plan
        assert sorted(r.node for r in got.collect()) == [1, 4]
    was, trees.FEW = trees.FEW, 1
    try:
        wide = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, i % 7 + 1) for i in range(1, 8)], "src long, dst long")
        assert sorted(r.node for r in trees.reachable(wide, spark.range(1)).collect()) == list(range(8))
    finally:
        trees.FEW = was
