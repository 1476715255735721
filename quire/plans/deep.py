"""Queries over nested and packed values: merged graphs, repaired forms, role chains, byte tables, sampled grids, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import calc, getters, xref
from quire.operators import actions, clone, fields, trees
from quire.session import table
from quire.streaming import updates


def _graph(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _entry(rows, node, child, key=None, idx=None):
    return rows.select("doc", node.alias("node"), (F.lit(None).cast("string") if key is None else key).alias("key"), (F.lit(None).cast("long") if idx is None else idx.cast("long")).alias("idx"), child.alias("child"))


def _place(rows, order):
    from pyspark.sql import Window

    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(order)) - 1)


def clone_merge_graph(spark, sf):
    """Per nation, the customers' dictionary merged into the suppliers': arrays end to end, shared keys level by level, cycles kept."""
    sup = _place(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("v")), "id")
    cus = _place(table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"), F.col("c_name").alias("v"), F.col("c_mktsegment").alias("seg")), "id")
    lit, cat = F.lit, F.concat

    def side(rows, mod):
        """root: {names: [..], info: {k..: .., up: root}}"""
        docs = rows.select("doc").distinct()
        name = rows.select("doc", "k", cat(lit("n"), "id").alias("node"), lit("text").alias("kind"), F.col("v").alias("value"))
        info = rows.groupBy("doc", (F.col("id") % mod).alias("m")).agg(F.min("v").alias("value")).select("doc", cat(lit("k"), "m").alias("node"), lit("text").alias("kind"), "value")
        fixed = [docs.select("doc", lit(n).alias("node"), lit(k).alias("kind"), lit(None).cast("string").alias("value")) for n, k in (("root", "dict"), ("names", "array"), ("info", "dict"))]
        nodes = _graph([*fixed, name.drop("k"), info])
        entries = _graph([_entry(docs, lit("root"), lit("names"), lit("names")), _entry(docs, lit("root"), lit("info"), lit("info")), _entry(docs, lit("info"), lit("root"), lit("up")), _entry(name, lit("names"), F.col("node"), idx=F.col("k")), _entry(info, lit("info"), F.col("node"), F.col("node"))])
        return nodes, entries

    t, (nodes, entries) = side(sup, 7), side(cus, 11)
    # only the source has "deep": {segment: [customer keys]}, and a way back up
    deep = cus.withColumn("arr", cat(lit("d"), "seg")).withColumn("leaf", cat(lit("c"), "id"))
    docs, segs = deep.select("doc").distinct(), deep.select("doc", "seg", "arr").distinct()
    none = lit(None).cast("string").alias("value")
    nodes = _graph([nodes, docs.select("doc", lit("deep").alias("node"), lit("dict").alias("kind"), none), segs.select("doc", F.col("arr").alias("node"), lit("array").alias("kind"), none), deep.select("doc", F.col("leaf").alias("node"), lit("number").alias("kind"), F.col("id").cast("string").alias("value"))])
    ranked = _place(deep.select(F.struct("doc", "seg").alias("doc"), "arr", "leaf", "id"), "id").select("doc.doc", "arr", "leaf", "k")
    entries = _graph([entries, _entry(docs, lit("root"), lit("deep"), lit("deep")), _entry(docs, lit("deep"), lit("deep"), lit("self")), _entry(segs, lit("deep"), F.col("arr"), F.col("seg")), _entry(ranked, F.col("arr"), F.col("leaf"), idx=F.col("k"))])
    roots = t[0].where("node = 'root'").select("doc", lit("root").alias("s"), lit("root").alias("t")).join(nodes.where("node = 'root'").select("doc"), "doc", "left_semi")
    got_nodes, got = clone.merged((nodes, entries), t, roots)
    return got.join(got_nodes.select("doc", F.col("node").alias("child"), "kind", "value"), ["doc", "child"]).select("doc", "node", "key", "idx", "child", "kind", "value")


def form_repair(spark, sf):
    """Fields anew from widgets: chains of up to four parents, some of them in circles."""
    key = F.col("c_custkey")
    parent = F.when(key % 50 == 48, key + 1).when(key % 5 != 0, key - 1)
    nodes = table(spark, sf, "customer").select(F.floor(key / 1000).alias("doc"), key.alias("node"), F.when(F.floor(parent / 1000) == F.floor(key / 1000), parent).alias("parent"), F.col("c_mktsegment").alias("name"))
    o = table(spark, sf, "orders")
    widgets = o.select(F.floor(F.col("o_custkey") / 1000).alias("doc"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("widget"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("parent"), F.concat(F.lit("w"), "o_orderkey").alias("name"))
    ready = nodes.where("doc % 4 <> 3").select("doc")
    return fields.repaired(widgets, nodes, ready)


def role_chains(spark, sf):
    """A part's role through the chain of types, brands and sizes; names have none."""
    p = table(spark, sf, "part").withColumn("size", F.concat(F.lit("size"), "p_size"))
    steps = [p.groupBy(F.col(a).alias("role")).agg(F.min(b).alias("to")) for a, b in (("p_type", "p_brand"), ("p_brand", "size"))]
    return fields.standard_roles(p.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("role")), steps[0].unionByName(steps[1])).select("p_partkey", "standard")


def xref_streams(spark, sf):
    """A customer's orders as the bytes of a cross-reference stream, decoded by columns alone."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    entry = F.concat(F.lpad(F.hex(F.col("o_orderkey") % 3), 2, "0"), F.lpad(F.hex("o_orderkey"), 8, "0"), F.lpad(F.hex(F.col("o_orderkey") % 100), 4, "0"))
    made = o.withColumn("e", entry).groupBy("o_custkey").agg(F.expr("unhex(listagg(e, '') WITHIN GROUP (ORDER BY o_orderkey))").alias("data"), F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    made = made.select("o_custkey", "data", F.array(*map(F.lit, (1, 4, 2))).alias("w"), F.array(F.lit(10).cast("long"), half, F.lit(1000).cast("long"), F.col("n") - half).alias("index"))
    return xref.stream_rows(made, ["o_custkey"], "data", "w", "index")


def page_hints(spark, sf):
    """A page hint table for each customer, a page an order, packed in bits and unpacked by columns alone."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 29).alias("a"), (F.col("o_orderkey") % 1000).alias("b"))
    packed = lambda c, n: F.expr(f"listagg(lpad(bin({c}), {n}, '0'), '') WITHIN GROUP (ORDER BY o_orderkey)")
    sums = o.groupBy("o_custkey").agg(packed("a", 5).alias("x"), packed("b", 10).alias("y"), F.count("*").alias("n"))
    whole = lambda c: F.rpad(c, (F.ceil(F.length(c) / 8) * 8).cast("int"), F.lit("0"))
    digits = F.concat(whole(F.col("x")), whole(F.col("y")))
    # four binary digits a hexadecimal one
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("z") / 4).cast("int") - 1), lambda i: F.conv(F.substring(F.col("z"), i * 4 + 1, F.lit(4)), 2, 16)), "")
    head = "".join(f"{v:0{2 * n}x}" for v, (_, n) in zip((3, 0, 5, 40, 10, 0, 0, 0, 0, 0, 0, 0, 0), xref.HINTS))
    made = sums.withColumn("z", digits).select("o_custkey", "n", F.unhex(F.concat(F.lit(head), hexed)).alias("data"))
    return xref.page_hints(made, ["o_custkey"], "data", "n")


#: Grids of two and three inputs (fixed values of the demonstration), the first input fastest.
GRID2, GRID3 = [[(37 * i) % 256, (91 * i + 5) % 256] for i in range(12)], [[(53 * i + 11) % 256] for i in range(24)]


def fn_type0_grids(spark, sf):
    """Sampled functions of two and three inputs."""
    x, y, z = F.col("p_size").cast("double"), (F.col("p_partkey") % 101) / 100.0, (F.col("p_partkey") % 13).cast("double")
    two = calc.sampled_grid([x, y], [(0, 50), (0, 1)], [4, 3], GRID2, [(0, 1), (-1, 1)])
    three = calc.sampled_grid([x, y, z], [(0, 40), (0, 1), (0, 12)], [4, 3, 2], GRID3, [(0, 100)], encode=[(0, 3), (2, 0), (0, 1)], limits=[(5, 90)])
    return table(spark, sf, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in zip(("a", "b", "c"), [*two, *three])])


def variant_getters(spark, sf):
    """F8: typed getters with defaults on nested values."""
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"o": {"v": ['), F.coalesce(F.col("value").cast("decimal(12,2)").cast("string"), F.lit("null")), F.lit(', "'), "event_type", F.lit('", true], "it\'s": '), F.col("event_id").cast("string"), F.lit("}, \"n\": null}"))
    v = F.when(F.col("event_id") % 7 == 0, getters.parsed(F.lit("{broken"))).otherwise(getters.parsed(text))
    e = e.select("event_id", v.alias("v"))
    c = F.col("v")
    return e.select(
        "event_id", F.round(getters.get(c, "double", -1.0, "o", "v", 0), 6).alias("number"), getters.get(c, "string", "none", "o", "v", 1).alias("kind"), getters.get(c, "int", -1, "o", "v", 1).alias("no_number"),
        getters.get(c, "boolean", False, "o", "v", 2).alias("flag"), getters.get(c, "long", -1, "o", "it's").alias("id"), getters.get(c, "string", "none", "n").alias("null_one"), getters.get(c, "string", "none", "o", "v", 9).alias("missing"),
        getters.size(c, "o", "v").alias("entries"), F.coalesce(getters.has(c, "n"), F.lit(False)).alias("has_null"),
    )


#: Between the two snapshots of the stream of versions.
CUT = "2024-01-16"


def version_stream(spark, sf):
    """G18 as a stream: events as versions of objects, every fifth of them a deletion, in two runs from one checkpoint."""
    at = trees.scratch(spark, "versions")
    versions = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "props", (F.col("event_id") % 5 == 0).alias("gone"))
    for part in (F.col("ts") < CUT, F.col("ts") >= CUT):
        versions.where(part).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(versions.schema).parquet(f"{at}/in")
        updates.follow(updates.changes(stream, ["user_id", "event_type"], ["props"], "ts", "event_id", "gone"), f"{at}/state", f"{at}/out")
    return spark.read.parquet(f"{at}/out").select("user_id", "event_type", F.col("ord").alias("event_id"), "change")


def action_chains(spark, sf):
    """Actions with those that follow them, in the order in which they run."""
    e = table(spark, sf, "events")
    ident = F.col("event_id").cast("string")
    rest = F.concat(F.lit('{"S": "GoTo", "D": "p'), ident, F.lit('", "Next": {"S": "Named", "N": "NextPage"}}, {"S": "Other", "Next": {"S": "URI", "URI": "lost"}}, {"S": "GoToR", "D": "x", "F": {"F": "f'), ident, F.lit('"}, "NewWindow": true}'))
    first = F.when(F.col("event_type") == "click", F.concat(F.lit('"S": "URI", "URI": "http://x.org/'), ident, F.lit('"'))).otherwise(F.lit('"S": "SubmitForm", "F": "to", "Flags": 4'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), first, F.lit("}"))).otherwise(F.concat(F.lit("{"), first, F.lit(', "Next": ['), rest, F.lit("]}")))
    return actions.chain(e.select("event_id", getters.parsed(text).alias("v")), ["event_id"], "v")


QUERIES = {f.__name__: f for f in (action_chains, version_stream, clone_merge_graph, form_repair, role_chains, xref_streams, page_hints, fn_type0_grids, variant_getters)}


def _lerp(table: list[list[int]], out: int, axes: list[tuple[str, int]]) -> str:
    """The weighted mean of the points around (l.., h.., f..) of each axis, as a sum over corners."""
    terms = []
    for corner in range(1 << len(axes)):
        weight, index, stride = [], [], 1
        for i, (a, n) in enumerate(axes):
            up = corner >> i & 1
            weight.append(f"{a}f" if up else f"(1 - {a}f)")
            index.append(f"{'h' if up else 'l'}{a} * {stride}")
            stride *= n
        terms.append(f"{' * '.join(weight)} * {[r[out] for r in table]}[CAST({' + '.join(index)} + 1 AS INT)]")
    return " + ".join(terms)


_NEWEST = "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(coalesce(props, ''), (ts, event_id)) AS props, max_by(event_id % 5 = 0, (ts, event_id)) AS gone FROM events WHERE ts"
_AXIS = lambda a: f"{a}, floor({a}) AS l{a}, ceil({a}) AS h{a}, {a} - floor({a}) AS {a}f"
SQL = {
    "action_chains": """
SELECT event_id, 0 AS ord, 0 AS depth, CASE WHEN event_type = 'click' THEN 'URI' ELSE 'SubmitForm' END AS kind, CASE WHEN event_type = 'click' THEN 'http://x.org/' || event_id END AS uri, NULL AS dest, CASE WHEN event_type <> 'click' THEN 'to' END AS file, NULL AS script, NULL AS named, CASE WHEN event_type <> 'click' THEN 4 END AS flags, CAST(NULL AS BOOLEAN) AS new_window FROM events
UNION ALL SELECT event_id, 1, 1, 'GoTo', NULL, 'p' || event_id, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 2, 2, 'Named', NULL, NULL, NULL, NULL, 'NextPage', NULL, NULL FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 3, 1, 'GoToR', NULL, 'x', 'f' || event_id, NULL, NULL, NULL, true FROM events WHERE event_id % 3 <> 0""",
    "version_stream": f"""
WITH a AS ({_NEWEST} < TIMESTAMP '{CUT}' GROUP BY ALL), b AS ({_NEWEST} >= TIMESTAMP '{CUT}' GROUP BY ALL)
SELECT user_id, event_type, event_id, 'added' AS change FROM a WHERE NOT gone
UNION ALL SELECT b.user_id, b.event_type, b.event_id, CASE WHEN coalesce(a.gone, true) THEN 'added' WHEN b.gone THEN 'removed' ELSE 'modified' END
FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE CASE WHEN coalesce(a.gone, true) THEN NOT b.gone ELSE b.gone OR a.props <> b.props END""",
    "clone_merge_graph": """
WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS id, s_name AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier),
c AS (SELECT c_nationkey AS doc, c_custkey AS id, c_name AS v, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS ks FROM customer),
sd AS (SELECT doc, count(*) AS n FROM s GROUP BY doc), cd AS (SELECT DISTINCT doc FROM c WHERE doc IN (SELECT doc FROM sd)),
si AS (SELECT doc, 'k' || (id % 7) AS key, min(v) AS value FROM s GROUP BY ALL), ci AS (SELECT doc, 'k' || (id % 11) AS key, min(v) AS value FROM c GROUP BY ALL),
r AS (
  SELECT doc, 't:root' AS node, 'names' AS key, NULL AS idx, 't:names' AS child, 'array' AS kind, NULL AS value FROM sd
  UNION ALL SELECT doc, 't:root', 'info', NULL, 't:info', 'dict', NULL FROM sd
  UNION ALL SELECT doc, 't:info', 'up', NULL, 't:root', 'dict', NULL FROM sd
  UNION ALL SELECT doc, 't:names', NULL, k, 't:n' || id, 'text', v FROM s
  UNION ALL SELECT c.doc, 't:names', NULL, sd.n + k, 's:n' || id, 'text', v FROM c JOIN sd ON sd.doc = c.doc
  UNION ALL SELECT doc, 't:info', key, NULL, 't:' || key, 'text', value FROM si
  UNION ALL SELECT ci.doc, 't:info', ci.key, NULL, 's:' || ci.key, 'text', ci.value FROM ci JOIN cd USING (doc) LEFT JOIN si ON si.doc = ci.doc AND si.key = ci.key WHERE si.key IS NULL
  UNION ALL SELECT doc, 't:root', 'deep', NULL, 's:deep', 'dict', NULL FROM cd
  UNION ALL SELECT doc, 's:deep', 'self', NULL, 's:deep', 'dict', NULL FROM cd
  UNION ALL SELECT DISTINCT c.doc, 's:deep', seg, NULL, 's:d' || seg, 'array', NULL FROM c JOIN cd ON cd.doc = c.doc
  UNION ALL SELECT c.doc, 's:d' || seg, NULL, ks, 's:c' || id, 'number', CAST(id AS VARCHAR) FROM c JOIN cd ON cd.doc = c.doc
)
SELECT doc, node, key, CAST(idx AS BIGINT) AS idx, child, kind, value FROM r""",
    "form_repair": """
WITH n AS (SELECT c_custkey // 1000 AS doc, c_custkey AS node, c_mktsegment AS name FROM customer),
t AS (SELECT doc, node, CASE WHEN node % 50 NOT IN (48, 49) THEN node - node % 5 END AS top FROM n),
w AS (SELECT o_custkey // 1000 AS doc, o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS parent FROM orders WHERE o_custkey // 1000 % 4 <> 3),
b AS (SELECT w.doc, w.ord, t.top AS field, n.name FROM w JOIN t ON t.doc = w.doc AND t.node = w.parent JOIN n ON n.doc = t.doc AND n.node = t.top)
SELECT doc, min(ord) AS ord, arg_min(field, ord) AS field, name FROM b GROUP BY doc, name
UNION ALL SELECT doc, ord, ord, 'w' || ord FROM w WHERE parent IS NULL AND doc IN (SELECT doc FROM n)""",
    "role_chains": """
WITH t AS (SELECT p_type AS role, min(p_brand) AS b FROM part GROUP BY 1), b AS (SELECT p_brand AS b, min('size' || p_size) AS m FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE m END AS standard FROM part LEFT JOIN t ON role = p_type LEFT JOIN b USING (b)""",
    "xref_streams": """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, CAST(CASE WHEN i < n // 2 THEN 10 + i ELSE 1000 + i - n // 2 END AS BIGINT) AS num, CASE o_orderkey % 3 WHEN 1 THEN 'at' ELSE 'in' END AS place, o_orderkey AS at, o_orderkey % 100 AS third FROM o WHERE o_orderkey % 3 <> 0""",
    "page_hints": """
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_idx, 3 + o_orderkey % 29 AS objects, 40 + o_orderkey % 1000 AS length FROM orders""",
    "fn_type0_grids": f"""
WITH i AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 101) / 100.0::DOUBLE AS y, (p_partkey % 13)::DOUBLE AS z FROM part),
e AS (SELECT p_partkey, least(s, 50) * (3 / 50.0::DOUBLE) AS a, y * 2 AS b, least(s, 40) * (3 / 40.0::DOUBLE) AS c, 2 - y * 2 AS d, z * (1 / 12.0::DOUBLE) AS g FROM i),
p AS (SELECT p_partkey, {", ".join(map(_AXIS, "abcdg"))} FROM e)
SELECT p_partkey, round(({_lerp(GRID2, 0, [("a", 4), ("b", 3)])}) / 255.0::DOUBLE, 6) AS a, round(-1 + ({_lerp(GRID2, 1, [("a", 4), ("b", 3)])}) * (2 / 255.0::DOUBLE), 6) AS b,
       round(least(greatest(({_lerp(GRID3, 0, [("c", 4), ("d", 3), ("g", 2)])}) * (100 / 255.0::DOUBLE), 5), 90), 6) AS c FROM p""",
    "variant_getters": """
SELECT event_id, round(CASE WHEN event_id % 7 <> 0 THEN coalesce(CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE), -1) ELSE -1 END, 6) AS number, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE 'none' END AS kind, -1 AS no_number,
       event_id % 7 <> 0 AS flag, CASE WHEN event_id % 7 <> 0 THEN event_id ELSE -1 END AS id, 'none' AS null_one, 'none' AS missing, CASE WHEN event_id % 7 <> 0 THEN 3 ELSE 0 END AS entries, event_id % 7 <> 0 AS has_null FROM events""",
}
