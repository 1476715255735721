"""Queries over the tables that stand for references, trees, forms and several documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import joins, layout, multidoc, ranks, trees
from quire.session import table
from quire.streaming import windows

RANGES = ((0, 99, 1000), (100, 149, 1100), (150, 199, 3000), (260, 900, 5000))


def _ranges(spark):
    return spark.createDataFrame(list(RANGES), "lo bigint, hi bigint, base bigint")


def doc_info_snapshot(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    d = docs.join(labels, "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct("lang", "n_chars", "source")).alias("info"), F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality"))


def event_props_typed_get(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("-1")).alias("missing"))


def xref_latest_wins(spark, sf):
    return joins.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def as_of_prior_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.expr("timestamp'1996-06-01'").alias("at"))
    return joins.as_of(c, joins.latest(o, ["key", "o_orderdate"], "o_orderkey"), ["key"], "at", "o_orderdate", ["o_orderkey"]).select("key", "o_orderkey")


def cid_map_range(spark, sf):
    return joins.range_lookup(table(spark, sf, "part").select("p_partkey"), "p_partkey", _ranges(spark))


def cid_unmap(spark, sf):
    r = _ranges(spark).select(F.col("base").alias("lo"), F.expr("base + hi - lo").alias("hi"), F.col("lo").alias("base"))
    return joins.range_lookup(table(spark, sf, "orders").select("o_orderkey").distinct(), "o_orderkey", r)


def range_coalesce(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("lo")).agg(F.max("l_returnflag").alias("flag"))
    return joins.coalesce_ranges(li.select("l_orderkey", "lo", F.col("lo").alias("hi"), F.expr("lo + CASE flag WHEN 'N' THEN 100 ELSE 500 END").alias("base")), ["l_orderkey"])


def codespace_match(spark, sf):
    code = F.unhex(F.lpad(F.hex("p_partkey"), 4, "0"))
    return table(spark, sf, "part").select("p_partkey", joins.in_codespace(code, b"\x00\x20", b"\x05\x7f").alias("inside"))


def orphan_repair(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    lone = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("owner"), F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(True).alias("made"))
    return o.select(F.col("o_custkey").alias("owner"), "o_orderkey", F.lit(False).alias("made")).unionByName(lone)


def named_dest_resolve(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", F.coalesce("r_name", "n_name", F.lit("none")).alias("dest"))


def outline_dest_coalesce(spark, sf):
    c, n, s = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    first = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("s_name"))
    return c.join(first, c.c_nationkey == first.k, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("s_name", "n_name").alias("dest"))


def _nodes(spark, sf):
    r, n, c = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer")
    a = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    d = c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name")
    return a.union(b).union(d)


def field_tree_fqn(spark, sf):
    return trees.walk(_nodes(spark, sf)).select("node", F.col("path").alias("fqn"), "depth")


def outline_tree(spark, sf):
    return trees.walk(_nodes(spark, sf)).select("node", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("line"))


def descendants(spark, sf):
    return trees.walk(_nodes(spark, sf), "/").select(F.substring_index("path", "/", 1).alias("root")).groupBy("root").agg((F.count("*") - 1).alias("below"))


def kid_counts(spark, sf):
    return _nodes(spark, sf).where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("kids"))


def tree_limits(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_name").alias("least"), F.max("p_name").alias("greatest"), F.count("*").alias("n"))


def split_chunks(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_no"))
    return multidoc.split_every(li, 3).groupBy("l_orderkey", "chunk").agg(F.count("*").alias("pages"), F.min("page_no").alias("first"))


def split_by_bookmark(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    marks = li.where("l_returnflag = 'N'")
    ends = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("pages"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return marks.withColumn("next", F.lead("l_linenumber").over(w) - 1).join(ends, "l_orderkey").select("l_orderkey", F.col("l_linenumber").alias("first"), F.coalesce("next", "pages").alias("last"))


def merge_documents(spark, sf):
    a = table(spark, sf, "documents").select(F.lit(0).alias("source_ord"), F.col("doc_id").alias("id"))
    b = table(spark, sf, "benchmark").select(F.lit(1).alias("source_ord"), F.col("item_id").alias("id"))
    return ranks.numbered(a.unionByName(b), ["source_ord", "id"], "page_no")


def merge_rename(spark, sf):
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_ord"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"))
    return multidoc.rename_collisions(f)


def merge_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    kept = d.where("lang IS NULL OR lang = 'en'").select("doc_id", "lang")
    rest = d.where("lang <> 'en'").groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")
    return kept.unionByName(rest)


def content_hash_dedup(spark, sf):
    return multidoc.unique_content(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256", "copies")


def snapshot_diff(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    old, new = o.where("o_orderdate < '2000-12-01'"), o.where("o_orderdate >= '1995-09-01'")
    return multidoc.changed(old.drop("o_orderdate"), new.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")), ["o_orderkey"])


def resource_reachability(spark, sf):
    edges = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey * 2").alias("dst"))
    return trees.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")))


def marked_content_depth(spark, sf):
    c = table(spark, sf, "conversations")
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return layout.marked_depth(c.select("conv_id", "turn", "role"), ["conv_id"], "turn", step).select("conv_id", "turn", "depth")


def marked_content_parent(spark, sf):
    from pyspark.sql import Window

    opened = marked_content_depth(spark, sf).join(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"])
    both = opened.select("conv_id", "turn", F.col("depth").alias("key"), F.col("turn").alias("open"), F.lit(0).alias("ask")).unionByName(opened.select("conv_id", "turn", (F.col("depth") - 1).alias("key"), F.lit(None).cast("bigint").alias("open"), F.lit(1).alias("ask")))
    w = Window.partitionBy("conv_id", "key").orderBy("turn", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("parent", F.last("open", ignorenulls=True).over(w)).where("ask = 1").select("conv_id", "turn", "parent")


def rotation_angles(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[1].cast("double").alias("b"), F.col("embedding")[3].cast("double").alias("d"))
    return e.select("vec_id", scalars.rotation(F.col("b"), F.col("d")).alias("angle"))


def angle_filter(spark, sf):
    return rotation_angles(spark, sf).where("angle < 90").groupBy("angle").agg(F.count("*").alias("n"))


def overlay_selection(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_no"))
    last = p.groupBy("l_orderkey").agg(F.max("page_no").alias("last"))
    which = F.when(F.col("page_no") == 3, "specific").when(F.col("page_no") == 1, "first").when(F.col("page_no") == F.col("last"), "last").when(F.col("page_no") % 2 == 1, "odd").otherwise("even")
    return p.join(last, "l_orderkey").groupBy(which.alias("overlay")).agg(F.count("*").alias("n"))


def permission_bits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[((F.col("p_size") * 52).bitwiseAND(1 << (b - 1)) != 0).alias(n) for b, n in ((3, "can_print"), (4, "can_modify"), (5, "can_extract"), (6, "can_annotate"))])


def object_packing(spark, sf):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor((rn - 1) / 2).cast("int").alias("container"))


def xref_offsets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "documents").select("source", "doc_id", F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("offset"))


def field_import(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    v = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return d.join(v, "doc_id", "left").select("doc_id", F.coalesce("value", "lang").alias("value"))


def stream_event_windows(spark, sf):
    got = windows.tumbling(table(spark, sf, "events"))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_event_sessions(spark, sf):
    got = windows.sessions(table(spark, sf, "events"), "2 hours")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (doc_info_snapshot, event_props_typed_get, xref_latest_wins, as_of_prior_order, cid_map_range, cid_unmap, range_coalesce, codespace_match, orphan_repair, named_dest_resolve, outline_dest_coalesce, field_tree_fqn, outline_tree, descendants, kid_counts, tree_limits, split_chunks, split_by_bookmark, merge_documents, merge_rename, merge_dedup, content_hash_dedup, snapshot_diff, resource_reachability, marked_content_depth, marked_content_parent, rotation_angles, angle_filter, overlay_selection, permission_bits, object_packing, xref_offsets, field_import, stream_event_windows, stream_event_sessions)}

_R = "r(lo, hi, base) AS (VALUES " + ", ".join(str(r) for r in RANGES) + ")"
_NODES = "nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"
_WALK = f"WITH RECURSIVE {_NODES}, t AS (SELECT node, parent, name, 0 AS depth, name AS path, name AS root FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, n.parent, n.name, depth + 1, path || '.' || n.name, root FROM t JOIN nodes n ON n.parent = t.node)"
_DEPTH = "s AS (SELECT conv_id, turn, role, sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations), d AS (SELECT conv_id, turn, role, CAST(s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) AS INT) AS depth FROM s)"
SQL = {
    "doc_info_snapshot": """SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' AS info, coalesce(CAST(quality AS VARCHAR), 'none') AS quality FROM documents LEFT JOIN labels USING (doc_id)""",
    "event_props_typed_get": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), '-1') AS missing FROM events",
    "xref_latest_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "as_of_prior_order": "WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS key, TIMESTAMP '1996-06-01' AS at FROM customer) SELECT key, o_orderkey FROM c ASOF LEFT JOIN o ON c.key = o.o_custkey AND c.at >= o.o_orderdate",
    "cid_map_range": f"WITH {_R} SELECT p_partkey, CAST(coalesce(base + p_partkey - lo, -1) AS BIGINT) AS cid FROM part LEFT JOIN r ON p_partkey BETWEEN lo AND hi",
    "cid_unmap": f"WITH {_R} SELECT o_orderkey, CAST(coalesce(lo + o_orderkey - base, -1) AS BIGINT) AS cid FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN r ON o_orderkey BETWEEN base AND base + hi - lo",
    "range_coalesce": "WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_returnflag) = 'N' AS f FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY n) AS i FROM g) SELECT k AS l_orderkey, CAST(min(n) AS BIGINT) AS lo, CAST(max(n) AS BIGINT) AS hi, CAST(min(n) + CASE WHEN f THEN 100 ELSE 500 END AS BIGINT) AS base FROM r GROUP BY k, f, n - i",
    "codespace_match": "SELECT p_partkey, p_partkey // 256 BETWEEN 0 AND 5 AND p_partkey % 256 BETWEEN 32 AND 127 AS inside FROM part",
    "orphan_repair": "SELECT o_custkey AS owner, o_orderkey, false AS made FROM orders UNION ALL SELECT c_custkey, NULL, true FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "named_dest_resolve": "SELECT s_suppkey, coalesce(r_name, n_name, 'none') AS dest FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "outline_dest_coalesce": "SELECT c_custkey, coalesce(s_name, n_name) AS dest FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey LEFT JOIN nation ON n_nationkey = c_nationkey",
    "field_tree_fqn": f"{_WALK} SELECT node, path AS fqn, depth FROM t",
    "outline_tree": f"{_WALK} SELECT node, repeat('  ', depth) || name AS line FROM t",
    "descendants": f"{_WALK} SELECT root, count(*) - 1 AS below FROM t GROUP BY root",
    "kid_counts": f"WITH {_NODES} SELECT parent, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent",
    "tree_limits": "SELECT p_brand, min(p_name) AS least, max(p_name) AS greatest, count(*) AS n FROM part GROUP BY p_brand",
    "split_chunks": "SELECT l_orderkey, CAST((l_linenumber - 1) // 3 AS INT) AS chunk, count(*) AS pages, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2",
    "split_by_bookmark": "SELECT l_orderkey, l_linenumber AS first, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, pages) AS last FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS pages FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE l_returnflag = 'N'",
    "merge_documents": "SELECT *, row_number() OVER (ORDER BY source_ord, id) AS page_no FROM (SELECT 0 AS source_ord, doc_id AS id FROM documents UNION ALL SELECT 1, item_id FROM benchmark)",
    "merge_rename": "WITH f AS (SELECT s_suppkey AS source_ord, 'n' || s_nationkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT source_ord, name, CASE WHEN k = 1 THEN name ELSE 'dummyFieldName' || sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY source_ord, name) END AS merged_name FROM f",
    "merge_dedup": "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang = 'en' UNION ALL SELECT min(doc_id), lang FROM documents WHERE lang <> 'en' GROUP BY lang, text",
    "content_hash_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY text",
    "snapshot_diff": "WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < DATE '2000-12-01'), b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS s FROM orders WHERE o_orderdate >= DATE '1995-09-01') SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE o_orderstatus IS DISTINCT FROM s",
    "resource_reachability": "WITH RECURSIVE t AS (SELECT 1::BIGINT AS node UNION SELECT p_partkey * 2 FROM t JOIN part ON p_partkey = node) SELECT node FROM t",
    "marked_content_depth": f"WITH {_DEPTH} SELECT conv_id, turn, depth FROM d",
    "marked_content_parent": f"WITH {_DEPTH} SELECT conv_id, turn, (SELECT max(e.turn) FROM d e WHERE e.conv_id = d.conv_id AND e.role = 'user' AND e.turn < d.turn AND e.depth = d.depth - 1) AS parent FROM d WHERE role = 'user'",
    "rotation_angles": "SELECT vec_id, CAST((CAST(round_even(degrees(atan2(embedding[2]::DOUBLE, embedding[4]::DOUBLE)), 0) AS INT) + 360) % 360 AS INT) AS angle FROM embeddings",
    "angle_filter": "SELECT angle, count(*) AS n FROM (SELECT CAST((CAST(round_even(degrees(atan2(embedding[2]::DOUBLE, embedding[4]::DOUBLE)), 0) AS INT) + 360) % 360 AS INT) AS angle FROM embeddings) WHERE angle < 90 GROUP BY angle",
    "overlay_selection": "SELECT CASE WHEN l_linenumber = 3 THEN 'specific' WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = m THEN 'last' WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END AS overlay, count(*) AS n FROM (SELECT l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1",
    "permission_bits": "SELECT p_partkey, (p_size * 52) & 4 <> 0 AS can_print, (p_size * 52) & 8 <> 0 AS can_modify, (p_size * 52) & 16 <> 0 AS can_extract, (p_size * 52) & 32 <> 0 AS can_annotate FROM part",
    "object_packing": "SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 2 AS INT) AS container FROM lineitem",
    "xref_offsets": "SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents",
    "field_import": "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS value FROM documents LEFT JOIN labels USING (doc_id)",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_event_sessions": "WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id",
}
