"""Connected components by alternating star contractions, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots: the least node it reaches.

    Each round ties every node's larger neighbours to the least one it knows, then its
    smaller ones; the number of rounds grows with the logarithm of the largest component.
    No neighbourhood is ever gathered: least neighbours are aggregates with partial sums,
    and a node with very many links is a key that the join may split. Each round is
    written to the shared folder, which cuts the lineage.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, last = scratch.keep(edges, f"{name}0"), None
    for k in range(1, 64):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.keep(small, f"{name}{k}")
        now = tuple(edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}{k - 1}")
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components are not whole after 63 rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
