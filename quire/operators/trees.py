"""Trees and graphs by rounds of joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name where driver and executors share files; in local mode one of this machine will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{at or 'file://' + tempfile.mkdtemp(prefix='quire-')}/{name}-{uuid.uuid4().hex}"


def checkpoints(frame: DataFrame) -> None:
    """Have checkpoints go to the folder that driver and executors share; in local mode a folder of this machine will do."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="quire-"))


def walk(nodes: DataFrame, separator: str = ".", max_depth: int = 100) -> DataFrame:
    """(node, parent, name, depth, path) of every node below the roots (parent null).

    A round of joins a level, each checkpointed, so any number of rows may come out and
    neither the plan nor the work of a lost executor grows with the depth; an error if
    ``max_depth`` levels don't get to the end. Where nodes have several parents, each way to one is a row, and a
    node on its own path ends the walk there, so cycles do; in a forest none can come up.
    """
    checkpoints(nodes)
    nodes = nodes.select("node", "parent", "name").checkpoint()
    forest = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    new = nodes.where("parent IS NULL").select("node", "parent", "name", F.lit(0).alias("depth"), F.col("name").cast("string").alias("path"), *([] if forest else [F.array("node").alias("seen")])).checkpoint()
    out = new
    for _ in range(max_depth):
        above = new.select(F.col("node").alias("_above"), "depth", "path", *([] if forest else ["seen"]))
        below = nodes.join(above, F.col("parent") == F.col("_above"))
        if not forest:
            below = below.where(~F.array_contains("seen", F.col("node"))).withColumn("seen", F.array_append("seen", F.col("node")))
        new = below.select("node", "parent", "name", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit(separator), "name").alias("path"), *([] if forest else ["seen"])).checkpoint()
        if new.isEmpty():
            return out.select("node", "parent", "name", "depth", "path")
        out = out.unionByName(new)
    raise RuntimeError(f"nodes deeper than {max_depth} levels may be left")


def topmost(nodes: DataFrame) -> DataFrame:
    """(node, top, depth) of every (node, parent): the ancestor that has no parent, itself for such a node.

    Pointers are doubled in each round: a node's pointer goes to the place where its
    pointer's pointer goes, so a chain of n takes about log2(n) joins. A node with several parents follows the
    least. What stands in or below a cycle has no topmost ancestor and gets nulls, and so
    does what stands below a parent that is no node. An empty table gives an empty result.
    """
    checkpoints(nodes)
    at = nodes.groupBy("node").agg(F.min("parent").alias("to")).where("node IS NOT NULL")
    at = at.select("node", F.col("to").isNull().alias("done"), F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth")).checkpoint()
    left = at.where("NOT done").count()
    while left:
        ahead = at.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("done").alias("_done"), F.col("depth").alias("_depth"))
        step = at.where("NOT done").join(ahead, F.col("to") == F.col("_n"))  # a pointer to what is no node ends here
        at = at.where("done").unionByName(step.select("node", F.col("_done").alias("done"), F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"))).checkpoint()
        now = at.where("NOT done").count()
        # while a chain is left some node of it arrives in every round; else only cycles are left
        if now == left:
            break
        left = now
    found = at.where("done").select("node", F.col("to").alias("top"), "depth")
    return nodes.select("node").where("node IS NOT NULL").distinct().join(found, "node", "left")


#: Rows that a round of ``reachable`` may broadcast; more are shuffled.
FEW = 100_000


def _met(new: DataFrame, n: int, edges: DataFrame) -> DataFrame:
    """The ends of the edges that start at one of ``n`` nodes; the edges never go through the driver, whatever size they seem to have."""
    new, edges = (F.broadcast(new), edges) if n <= FEW else (new.hint("merge"), edges.hint("merge"))
    return new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()


def reachable(edges: DataFrame, roots: DataFrame, limit: int = 1000) -> DataFrame:
    """The nodes that the roots reach over (src, dst), the roots included.

    Rounds of joins until nothing new is found; an error if ``limit`` rounds don't get there. Each round's nodes are checkpointed, so
    neither the plan nor the work of a lost executor grows with the depth. What a round
    broadcasts has ``FEW`` rows at most.
    """
    checkpoints(edges)
    seen = new = roots.select(F.col(roots.columns[0]).alias("node")).distinct().checkpoint()
    known = n = new.count()
    for _ in range(limit):
        before = F.broadcast(seen) if known <= FEW else seen.hint("merge")
        new = _met(new, n, edges).join(before, "node", "left_anti").checkpoint()
        n = new.count()
        if not n:
            return seen
        seen, known = seen.unionByName(new), known + n
    raise RuntimeError(f"nodes deeper than {limit - 1} steps may be left")
