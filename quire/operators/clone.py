"""Merging one graph of dictionaries and arrays into another, with clones of what comes over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import trees


def merged(source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], roots: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The target's graph with the source's merged into it, as (nodes, entries).

    Either graph is nodes (doc, node, kind, value) and entries (doc, node, key, idx,
    child): a dictionary's entries have a key, an array's an ``idx`` from 0; kind is
    "dict", "array" or else. ``roots`` (doc, s, t) names the first pairs. In the result a
    node is "t:" or "s:" and its name, the latter for clones.

    A pair of arrays: clones of the source's elements are put behind the target's, none
    is left out. A pair of dictionaries: a key that the target lacks gets a clone; where both have it, their
    values are the next pair. Any other pair leaves the target as it is. No pair is taken twice, so cycles end.
    What is cloned is cloned once with all that it leads to, so cycles and shared nodes stay such. Where several
    sources meet one target, those of the lower level and, in it, the lesser name come first.

    Pairs go level by level, clones by rounds, both checkpointed; the work of a round is joins on
    (doc, node) and on (doc, node, key). An error if ``limit`` levels don't get to the end.
    """
    (s_nodes, s_entries), (t_nodes, t_entries) = source, target
    trees.checkpoints(s_nodes)
    s_kind, t_kind = s_nodes.select("doc", F.col("node").alias("s"), F.col("kind").alias("sk")), t_nodes.select("doc", F.col("node").alias("t"), F.col("kind").alias("tk"))
    s_of, t_of = (e.select("doc", F.col("node").alias(x), "key", F.col("idx").alias(f"{x}_idx"), F.col("child").alias(f"{x}_child")) for x, e in (("s", s_entries), ("t", t_entries)))
    new = roots.select("doc", "s", "t").distinct().withColumn("level", F.lit(0)).checkpoint()
    seen, sets, adds = new, None, None
    for level in range(1, limit + 1):
        typed = new.join(s_kind, ["doc", "s"]).join(t_kind, ["doc", "t"]).where("sk = tk")
        add = typed.where("sk = 'array'").join(s_of.drop("key"), ["doc", "s"]).select("doc", "t", "level", "s", "s_idx", "s_child")
        both = typed.where("sk = 'dict'").join(s_of.drop("s_idx"), ["doc", "s"]).join(t_of.drop("t_idx"), ["doc", "t", "key"], "left")
        lacks = both.where("t_child IS NULL").select("doc", "t", "key", "level", "s", "s_child")
        adds, sets = (add, lacks) if adds is None else (adds.unionByName(add), sets.unionByName(lacks))
        new = both.where("t_child IS NOT NULL").select("doc", F.col("s_child").alias("s"), F.col("t_child").alias("t")).distinct().join(seen, ["doc", "s", "t"], "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    else:
        raise RuntimeError(f"pairs deeper than {limit} levels may be left")
    # several sources of one key: the first
    sets = sets.groupBy("doc", "t", "key").agg(F.min_by("s_child", F.struct("level", "s")).alias("s_child")).checkpoint()
    length = t_entries.groupBy("doc", F.col("node").alias("t")).agg((F.max("idx") + 1).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc", "t").orderBy("level", "s", "s_idx")) - 1
    adds = adds.withColumn("_p", place).join(length, ["doc", "t"], "left").select("doc", "t", (F.coalesce("n", F.lit(0)) + F.col("_p")).alias("idx"), "s_child").checkpoint()

    ident = lambda c: F.struct("doc", F.col(c).alias("node"))
    begun = sets.select(ident("s_child").alias("node")).unionByName(adds.select(ident("s_child").alias("node")))
    cloned = trees.reachable(s_entries.select(ident("node").alias("src"), ident("child").alias("dst")), begun).select("node.*")
    t, s = (lambda c, x=x: F.concat(F.lit(f"{x}:"), F.col(c).cast("string")) for x in "ts")
    nodes = t_nodes.withColumn("node", t("node")).unionByName(s_nodes.join(cloned, ["doc", "node"], "left_semi").withColumn("node", s("node")))
    none = lambda kind: F.lit(None).cast(kind)
    entries = t_entries.select("doc", t("node").alias("node"), "key", F.col("idx").cast("long").alias("idx"), t("child").alias("child"))
    entries = entries.unionByName(s_entries.join(cloned, ["doc", "node"], "left_semi").select("doc", s("node").alias("node"), "key", F.col("idx").cast("long").alias("idx"), s("child").alias("child")))
    entries = entries.unionByName(sets.select("doc", t("t").alias("node"), "key", none("long").alias("idx"), s("s_child").alias("child")))
    entries = entries.unionByName(adds.select("doc", t("t").alias("node"), none("string").alias("key"), F.col("idx").cast("long").alias("idx"), s("s_child").alias("child")))
    return nodes, entries
