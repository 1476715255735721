"""Actions and the actions that follow them, from dictionaries of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import getters
from quire.operators import trees

#: The kinds of actions that are made of a dictionary; others give none (fixed values).
KINDS = ("GoTo", "GoToR", "GoToE", "Launch", "Thread", "URI", "Sound", "Movie", "Hide", "Named", "SubmitForm", "ResetForm", "ImportData", "JavaScript")


def chain(rows: DataFrame, keys: list[str], action: str, limit: int = 100) -> DataFrame:
    """(keys, ord, depth, kind, uri, dest, file, script, named, flags, new_window) of the actions that VARIANT dictionaries begin.

    What follows an action (``Next``, a dictionary or an array of such) comes behind it, in
    order, each with what follows it; ``ord`` counts from 0. A dictionary without a known
    kind is no action and nothing follows it. Properties are those of their own kinds, null
    elsewhere; a file is a text or the text in a file's dictionary. A round a level,
    checkpointed, and an error beyond ``limit`` levels.
    """
    trees.checkpoints(rows)
    kind = lambda v: getters.get(v, "string", None, "S")
    new = rows.select(*keys, F.array(F.lit(0)).alias("_at"), F.col(action).alias("_v")).where(kind(F.col("_v")).isin(*KINDS)).checkpoint()
    out = new
    for _ in range(limit):
        follows = F.coalesce(F.try_variant_get("_v", "$.Next", "array<variant>"), F.array(F.try_variant_get("_v", "$.Next", "variant")))
        below = new.select(*keys, "_at", F.posexplode(follows).alias("_k", "_n"))
        new = below.select(*keys, F.array_append("_at", F.col("_k")).alias("_at"), F.col("_n").alias("_v")).where(kind(F.col("_v")).isin(*KINDS)).checkpoint()
        if new.isEmpty():
            break
        out = out.unionByName(new)
    else:
        raise RuntimeError(f"actions deeper than {limit} levels may be left")
    v, k = F.col("_v"), F.col("kind")
    text = lambda *steps: getters.get(v, "string", None, *steps)
    out = out.withColumns({"kind": kind(v), "ord": (F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1).cast("int")})
    return out.select(
        *keys, "ord", (F.size("_at") - 1).alias("depth"), "kind", F.when(k == "URI", text("URI")).alias("uri"), F.when(k.isin("GoTo", "GoToR", "GoToE"), text("D")).alias("dest"),
        F.when(k.isin("GoToR", "GoToE", "Launch", "SubmitForm", "ImportData", "Thread"), F.coalesce(text("F"), text("F", "F"))).alias("file"), F.when(k == "JavaScript", text("JS")).alias("script"),
        F.when(k == "Named", text("N")).alias("named"), F.when(k.isin("SubmitForm", "ResetForm"), getters.get(v, "int", 0, "Flags")).alias("flags"),
        F.when(k.isin("GoToR", "GoToE", "Launch"), getters.get(v, "boolean", False, "NewWindow")).alias("new_window"),
    )
