"""Repair of form fields from their widgets, and chains of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import trees


def repaired(widgets: DataFrame, nodes: DataFrame, ready: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, ord, field, name): a form's top fields anew, from the widgets (doc, ord, widget, parent, name) of its pages.

    A widget with a parent stands for its topmost ancestor among ``nodes`` (doc, node,
    parent, name); of these the first of each name is taken, in the order of ``ord``. A
    widget without one is a field itself, whatever its name. Widgets whose ancestors lead
    into a cycle or nowhere give none. Only documents in ``ready`` (doc), those
    with default resources, are repaired; the others have no rows. ``ord`` should have no ties.
    """
    here = nodes.join(ready.select(doc).distinct(), doc, "left_semi")
    ident = lambda c: F.struct(F.col(doc).alias("d"), F.col(c).alias("n"))
    tops = trees.topmost(here.select(ident("node").alias("node"), F.when(F.col("parent").isNotNull(), ident("parent")).alias("parent"))).where("top IS NOT NULL")
    named = here.select(ident("node").alias("top"), "name").join(tops, "top").select(F.col("node.d").alias(doc), F.col("node.n").alias("parent"), F.col("top.n").alias("field"), "name")
    widgets = widgets.join(ready.select(doc).distinct(), doc, "left_semi")
    below = widgets.where("parent IS NOT NULL").select(doc, "ord", "parent").join(named, [doc, "parent"])
    # a least row by order with partial results, not a ranking: a name may have very many widgets
    first = below.groupBy(doc, "name").agg(F.min_by(F.struct("ord", "field"), "ord").alias("f")).select(doc, "f.ord", "f.field", "name")
    return first.unionByName(widgets.where("parent IS NULL").select(doc, "ord", F.col("widget").alias("field"), "name"))


def standard_roles(elements: DataFrame, roles: DataFrame, role: str = "role") -> DataFrame:
    """The elements with ``standard``, the role at the end of the chain that ``roles`` (role, to) begins at theirs.

    A role without an entry is at its own end; of several entries the least counts. A
    role on or before a cycle stands for itself. A null role stays null.
    """
    chain = roles.where("role IS NOT NULL AND to IS NOT NULL").groupBy("role").agg(F.min("to").alias("to"))
    ends = chain.select(F.col("to").alias("role")).distinct().join(chain, "role", "left_anti").withColumn("to", F.lit(None).cast("string"))
    tops = trees.topmost(chain.unionByName(ends).select(F.col("role").alias("node"), F.col("to").alias("parent")))
    found = tops.select(F.col("node").alias(role), F.col("top").alias("_top"))
    return elements.drop("standard").join(found, role, "left").withColumn("standard", F.coalesce("_top", role)).drop("_top")
