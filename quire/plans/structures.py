"""Queries over structure, marks, fields, fonts, metadata and forms, with the driver tables in the place of objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import cmaps
from quire.functions import structure as S
from quire.operators import layout, paragraphs, ranks, spatial, trees
from quire.plans.relations import _NODES, _nodes
from quire.plans.text import REGIONS, RUN
from quire.session import spread, table
from quire.sources import objects as O
from quire.sources.objects import Name, Ref
from quire.sources.runs import LINES_SQL, RUNS_SQL, lines, runs


def rotation_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set((F.col("l_linenumber") * 90 % 360).cast("int"))), ",").alias("angles"))


def longest_codes(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max(F.octet_length("p_name")).cast("int").alias("longest"), F.max("p_partkey").alias("highest"))


def bookmark_range(spark, sf):
    """The turns from a conversation's first user turn to its last assistant turn."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    marks = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("b"))
    return c.join(marks, "conv_id").where("turn BETWEEN a AND b").groupBy("conv_id").agg(F.count("*").alias("pages"))


def annotation_filter(spark, sf):
    notes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("notes"))
    kept = F.filter("notes", lambda n: (n["l_returnflag"] == "R") & (n["l_linenumber"] > 1))
    return notes.select("l_orderkey", F.size("notes").alias("notes"), F.size(kept).alias("kept"))


def structure_by_role(spark, sf):
    """elements by the standard role that their own is mapped to."""
    roles = spark.createDataFrame([("user", "P"), ("assistant", "P"), ("system", "H1")], "role string, standard string")
    return table(spark, sf, "conversations").join(F.broadcast(roles), "role", "left").where("coalesce(standard, role) = 'P'").groupBy("conv_id").agg(F.count("*").alias("n"))


def font_heights(spark, sf):
    p = table(spark, sf, "part")
    size, kind = F.col("p_size").cast("double"), F.col("p_partkey") % 3  # no capitals' height, one above the ascent, one below it
    return p.select("p_partkey", F.round(S.font_height(size * 20, F.when(kind == 0, 0.0).when(kind == 1, size * 9).otherwise(size * 7), size * 8, -size * 4), 6).alias("height"))


def font_style(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, "-BoldOblique").when(F.col("p_size") % 3 == 1, "-Italic").otherwise(""))
    return p.select("p_partkey", S.bold(name, F.col("p_size") > 48).alias("bold"), S.italic(name, F.lit(None).cast("boolean")).alias("italic"))


def field_flags(spark, sf):
    flags = F.col("p_partkey") * 4099
    return table(spark, sf, "part").select("p_partkey", *[S.flag(flags, n).alias(n) for n in ("read_only", "required", "no_export", "multiline", "password", "combo")])


def choice_options(spark, sf):
    entries = F.array(F.array("p_brand"), F.array("p_brand", "p_type"), F.array("p_brand", "p_type", "p_name"))
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(S.options(entries, 0), "|").alias("export"), F.array_join(S.options(entries, 1), "|").alias("display"))


def diacritics(spark, sf):
    """characters that mark others, counted in decomposed texts."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?![ー])[\p{Mn}\p{Sk}\p{Lm}]")).alias("n"))


def _bf(spark, sf):
    p = table(spark, sf, "part").where("p_partkey IS NOT NULL")
    lo = F.col("p_partkey") * 10
    listed = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_partkey") + 7, F.col("p_partkey") + 9))
    return p.select(lo.alias("lo"), (lo + F.col("p_size") % 6 - 1).alias("hi"), (F.col("p_partkey") + 5000).alias("base"), listed.alias("targets"))


def bf_ranges(spark, sf):
    return cmaps.bf_rows(_bf(spark, sf))


def encoded_names(spark, sf):
    """Names as codes and back to text by the encoding's table."""
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("k", "c"))
    coded = p.select("p_partkey", "k", F.ascii("c").alias("code")).join(F.broadcast(cmaps.encoding_rows(spark, "WinAnsiEncoding")), "code")  # 224 rows at most
    return coded.groupBy("p_partkey").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY k)").alias("name"))


def property_lists(spark, sf):
    """A sequence's own property list or the named one; without either it isn't opened."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "inline").alias("own"))
    named = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("named"))
    return o.join(named, "o_custkey", "left").select("o_orderkey", F.coalesce("own", "named").alias("props")).where("props IS NOT NULL")


def parent_tree(spark, sf):
    """Marked content (page, mcid) to its structure element."""
    marks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("mcid")).distinct()
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("mcid"), F.col("o_orderpriority").alias("element"))
    return marks.join(parents, ["page", "mcid"], "left").select("page", "mcid", F.coalesce("element", F.lit("")).alias("element"))


def bead_runs(spark, sf):
    """A run belongs to the first bead that holds it, else to none; beads come before the rest of a page."""
    beads = spark.createDataFrame([(k, *box) for k, (_, *box) in enumerate(REGIONS)], "bead int, rx int, ry int, rw int, rh int")
    got = spatial.first_region(runs(spark, sf), RUN, beads, "bead").withColumn("bead", F.coalesce("bead", F.lit(-1)))
    w = Window.partitionBy("doc_id", "page_idx").orderBy((F.col("bead") < 0).cast("int"), "bead", F.desc("y"), "x", "word_idx")
    return got.select(*RUN, "bead", F.row_number().over(w).alias("ord"))


def chunk_destinations(spark, sf):
    """A destination's page in the chunk that holds it; -1 where another chunk does."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page")).distinct()
    chunk = F.floor((F.col("page") - 1) / 3)
    target = F.col("page") % 5 + 1
    same = F.floor((target - 1) / 3) == chunk
    return li.select("l_orderkey", "page", chunk.cast("int").alias("chunk"), F.when(same, ((target - 1) % 3 + 1)).otherwise(-1).cast("int").alias("to_page"))


def name_tree_order(spark, sf):
    """O3: keys in the order of their bytes; O1: ties as they came."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = Window.partitionBy("c_nationkey").orderBy(F.encode("c_mktsegment", "UTF-8"), "c_custkey")
    return c.select("c_custkey", F.row_number().over(w).alias("place"))


def clone_renumber(spark, sf):
    """Objects get numbers behind the target's highest, and references follow by a join."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    first = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("highest"))
    new = ranks.numbered(c.select("c_custkey"), ["c_custkey"], "k").crossJoin(F.broadcast(first)).select("c_custkey", (F.col("k") + F.col("highest")).alias("new"))  # one row
    return o.join(new, o.o_custkey == new.c_custkey, "left").select("o_orderkey", F.col("new").alias("owner"))


def clone_merge(spark, sf):
    """Dictionaries by key, where the target's value stays; arrays one behind the other."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("target"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("source"))
    return a.join(b, "k", "full").select("k", F.coalesce("target", "source").alias("value"), F.array_join(F.array_compact(F.array("target", "source")), "+").alias("both"))


def content_below(spark, sf):
    """Whether an element or one below it has content of its own."""
    walked = trees.walk(_nodes(spark, sf), "/")
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_acctbal") > 9900).alias("has"))
    got = walked.join(c, "node", "left").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("path"), F.coalesce("has", F.lit(False)).alias("has"))
    return got.groupBy("path").agg(F.bool_or("has").alias("has"))


def local_names(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "MMMM").alias("month"), F.date_format("ts", "EEEE").alias("day"))


def string_equality(spark, sf):
    """Strings are equal if their text and their form are."""
    p = table(spark, sf, "part")
    a, b = F.struct(F.lower("p_brand").alias("t"), (F.col("p_size") % 2 == 0).alias("f")), F.struct(F.lower("p_type").alias("t"), F.lit(True).alias("f"))
    return p.select("p_partkey", (a == F.struct(F.lower("p_brand").alias("t"), F.lit(True).alias("f"))).alias("same"), (a == b).alias("other"))


def array_access(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.element_at("embedding", -1).cast("double").alias("last"), F.size(F.slice("embedding", 2, 3)).alias("n"), F.col("embedding")[1].cast("double").alias("second"))


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.struct(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")).alias("v"))
    return e.select("vec_id", F.round(F.sqrt(F.col("v.x") * F.col("v.x") + F.col("v.y") * F.col("v.y")), 6).alias("length"), F.round(F.col("v.x") * 2, 6).alias("x2"))


def unit_measure(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.measure(F.col("p_partkey") / 8, [("mi", 1.0), ("ft", 5280.0), ("in", 12.0)]).alias("text"))


def language_alternatives(spark, sf):
    d = table(spark, sf, "documents").select("source", F.when(F.col("lang") == "en", "x-default").otherwise(F.col("lang")).alias("lang"), F.col("doc_id").cast("string").alias("value"), "doc_id")
    return S.alternatives(d, "source", "lang", "value", "doc_id").select("source", F.array_join("langs", ",").alias("langs"))


def archive_claims(spark, sf):
    """Part and conformance of a packet; a conformance that no part knows is no claim."""
    level = F.element_at(F.array(*map(F.lit, ("A", "B", "U", "e", "f", "x", "C"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    packet = F.concat(F.lit("<r><part>"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("</part><conformance>"), level, F.lit("</conformance></r>"))
    p = table(spark, sf, "part").select("p_partkey", packet.alias("x"))
    found = F.expr("xpath_string(x, 'r/conformance')")
    return p.select("p_partkey", F.when(found.isin(*S.CONFORMANCE), F.expr("xpath_int(x, 'r/part')")).otherwise(0).alias("part"), F.when(found.isin(*S.CONFORMANCE), found).otherwise("").alias("conformance"))


def signature_digest(spark, sf):
    """The digest over all of a file but the place of the signature."""
    return table(spark, sf, "documents").select("doc_id", S.range_digest(F.encode("text", "UTF-8"), [(0, 100), (150, 1 << 30)]).alias("sha256"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


def aes_content(spark, sf):
    """Contents under AES in CBC mode with the vector in front, decrypted again."""
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"), F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("key"))
    sealed = d.select("doc_id", "key", F.aes_encrypt("b", "key", F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))).alias("e"))
    back = F.aes_decrypt("e", "key", F.lit("CBC"), F.lit("PKCS"))
    return sealed.select("doc_id", F.md5(back).alias("md5"), F.octet_length("e").alias("sealed"))


def xfdf_export(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", "n_name", F.concat(F.lit("<"), "n_name", F.lit("&>")).alias("value"))
    return S.xfdf(n, ["n_regionkey"], "n_name", "value")


def xfdf_import(spark, sf):
    """S3: XFDF texts of customers read back."""
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.struct(F.lit("name").alias("n"), F.col("c_name").alias("v")), F.struct(F.lit("segment & more").alias("n"), F.col("c_mktsegment").alias("v")))).alias("f"))
    docs = S.xfdf(c.select("c_custkey", "f.*"), ["c_custkey"], "n", "v").select("c_custkey", F.encode("xfdf", "UTF-8").alias("content"))
    return S.form_data(docs, "c_custkey", xml=True)


def fdf_import(spark, sf):
    """Form-data files with a parent field and two kids, read back by qualified name."""

    def rows(data: bytes):
        a, _, b = data.decode().partition("\t")
        held = {1: {"FDF": {"Fields": [Ref(2)]}}, 2: {"T": b"who", "Kids": [Ref(3), Ref(4)]}, 3: {"T": b"name", "V": a.encode("latin-1", "replace")}, 4: {"T": b"at", "V": b"\xfe\xff" + b.encode("utf-16-be")}}
        yield (O.write(held, 1).replace(b"%PDF-1.5", b"%FDF-1.2"),)

    from quire.sources import pdf

    c = table(spark, sf, "customer").select("c_custkey", F.encode(F.concat("c_name", F.lit("\t"), "c_mktsegment"), "UTF-8").alias("content"))
    return S.form_data(pdf.flat(c, "c_custkey", "content binary", rows), "c_custkey", xml=False)


def xmp_properties(spark, sf):
    """Packets with a language alternative, a bag and a plain property, as rows."""
    p = table(spark, sf, "part")
    title = F.concat(F.lit('<rdf:li xml:lang="x-default">'), "p_brand", F.lit('</rdf:li><rdf:li xml:lang="de">'), "p_type", F.lit("</rdf:li>"))
    packet = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="q"><dc:title><rdf:Alt>'),
        title, F.lit("</rdf:Alt></dc:title><dc:size>"), F.col("p_size").cast("string"), F.lit("</dc:size></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    got = S.xmp(p.select("p_partkey", F.encode(packet, "UTF-8").alias("content")), "p_partkey")
    return got.select("p_partkey", "property", "container", "place", F.coalesce("lang", F.lit("")).alias("lang"), "value")


def layout_exact(spark, sf):
    """L1, L2, L4, L7 as the ordered folds that they are."""
    base = spread(runs(spark, sf)).select("doc_id", "page_idx", "line_idx", "word_idx", "text", "x", (F.col("y") + F.col("word_idx") % 3 * 0.03).alias("y"), "width", "font_size", (F.col("line_idx").cast("long") * (1 << 32) + F.col("word_idx")).alias("seq"))
    got = paragraphs.reconstruct(base.withColumn("space", F.lit(3.0)), factor=0.4, drop=1.0)
    return got.groupBy("doc_id", "page_idx").agg(F.max("line_no").alias("lines"), F.max("ord").alias("runs"), F.count_if("word_break").alias("breaks"), F.count_if(F.col("paragraph") == "start").alias("paragraphs"))


def xref_totals(spark, sf):
    """K3, K6: new numbers behind the highest, in order, and where each object starts."""
    d = table(spark, sf, "documents").select("doc_id", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("n"))
    return ranks.running(d.where("doc_id IS NOT NULL"), "doc_id", "n", "offset").select("doc_id", F.col("offset").cast("long").alias("offset"))


QUERIES = {
    f.__name__: f
    for f in (
        rotation_sets, longest_codes, bookmark_range, annotation_filter, structure_by_role, font_heights, font_style, field_flags, choice_options, diacritics, bf_ranges, encoded_names, property_lists, parent_tree, bead_runs,
        chunk_destinations, name_tree_order, clone_renumber, clone_merge, content_below, local_names, string_equality, array_access, vectors, unit_measure, language_alternatives, archive_claims, signature_digest, aes_content,
        xfdf_export, xfdf_import, fdf_import, xmp_properties, layout_exact, xref_totals,
    )
}

_BEAD = "CASE " + " ".join(f"WHEN x >= {x} AND x < {x + w} AND y > {y} AND y <= {y + h} THEN {k}" for k, (_, x, y, w, h) in enumerate(REGIONS)) + " ELSE -1 END"
SQL = {
    "rotation_sets": "SELECT l_orderkey, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS angles FROM (SELECT DISTINCT l_orderkey, l_linenumber * 90 % 360 AS a FROM lineitem) GROUP BY l_orderkey",
    "longest_codes": "SELECT p_brand, CAST(max(octet_length(encode(p_name))) AS INT) AS longest, max(p_partkey) AS highest FROM part GROUP BY p_brand",
    "bookmark_range": "SELECT conv_id, count(*) AS pages FROM (SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS a, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS b FROM conversations) WHERE turn BETWEEN a AND b GROUP BY conv_id",
    "annotation_filter": "SELECT l_orderkey, CAST(count(*) AS INT) AS notes, CAST(count(*) FILTER (l_returnflag = 'R' AND l_linenumber > 1) AS INT) AS kept FROM lineitem GROUP BY l_orderkey",
    "structure_by_role": "SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant', 'P') GROUP BY conv_id",
    "font_heights": "SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 WHEN p_partkey % 3 = 1 THEN p_size * 6 ELSE p_size * 7 END / 1000.0::DOUBLE, 6) AS height FROM part",
    "font_style": "SELECT p_partkey, p_size > 48 OR p_size % 3 = 0 OR p_type ILIKE '%bold%' AS bold, p_size % 3 < 2 OR p_type ILIKE '%italic%' OR p_type ILIKE '%oblique%' AS italic FROM part",
    "field_flags": "SELECT p_partkey, (p_partkey * 4099) & 1 <> 0 AS read_only, (p_partkey * 4099) & 2 <> 0 AS required, (p_partkey * 4099) & 4 <> 0 AS no_export, (p_partkey * 4099) & 4096 <> 0 AS multiline, (p_partkey * 4099) & 8192 <> 0 AS password, (p_partkey * 4099) & 131072 <> 0 AS combo FROM part",
    "choice_options": "SELECT p_partkey, p_brand || '|' || p_brand AS export, p_brand || '|' || p_type AS display FROM part",
    "diacritics": r"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\p{Mn}\p{Sk}\p{Lm}]', '', 'g')) AS INT) AS n FROM documents",
    "bf_ranges": "SELECT code, unicode FROM (SELECT p_partkey * 10 + i AS code, CASE WHEN p_partkey % 3 = 0 THEN CASE i WHEN 0 THEN p_partkey + 7 WHEN 1 THEN p_partkey + 9 END ELSE p_partkey + 5000 + i END AS unicode FROM (SELECT p_partkey, unnest(range(0, p_size % 6)) AS i FROM part)) WHERE unicode IS NOT NULL",
    "encoded_names": "SELECT p_partkey, p_name AS name FROM part WHERE p_name <> ''",
    "property_lists": "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'inline' END, c_mktsegment) AS props FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus = 'F' OR c_mktsegment IS NOT NULL",
    "parent_tree": "SELECT DISTINCT l_orderkey AS page, l_linenumber AS mcid, coalesce(CASE WHEN l_linenumber = 1 THEN o_orderpriority END, '') AS element FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    "bead_runs": f"WITH {RUNS_SQL}, b AS (SELECT *, {_BEAD} AS bead FROM runs) SELECT doc_id, page_idx, line_idx, word_idx, bead, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY bead < 0, bead, y DESC, x, word_idx) AS ord FROM b",
    "chunk_destinations": "SELECT DISTINCT l_orderkey, l_linenumber AS page, CAST((l_linenumber - 1) // 3 AS INT) AS chunk, CAST(CASE WHEN (l_linenumber % 5) // 3 = (l_linenumber - 1) // 3 THEN (l_linenumber % 5) % 3 + 1 ELSE -1 END AS INT) AS to_page FROM lineitem",
    "name_tree_order": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY encode(c_mktsegment), c_custkey) AS place FROM customer",
    "clone_renumber": "SELECT o_orderkey, new AS owner FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + (SELECT max(s_suppkey) FROM supplier) AS new FROM customer) ON c_custkey = o_custkey",
    "clone_merge": "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(s_name, c_name) AS value, concat_ws('+', s_name, c_name) AS both FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "content_below": """WITH c AS (SELECT r_name, n_name, c_name, c_acctbal > 9900 AS has FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey)
SELECT path, bool_or(coalesce(has, false)) AS has FROM (SELECT r_name AS path, has FROM c UNION ALL SELECT r_name || '/' || n_name, has FROM c WHERE n_name IS NOT NULL UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, has FROM c WHERE c_name IS NOT NULL) GROUP BY path""",
    "local_names": "SELECT event_id, monthname(ts) AS month, dayname(ts) AS day FROM events",
    "string_equality": "SELECT p_partkey, p_size % 2 = 0 AS same, p_size % 2 = 0 AND lower(p_brand) = lower(p_type) AS other FROM part",
    "array_access": "SELECT vec_id, CAST(embedding[-1] AS DOUBLE) AS last, CAST(len(embedding[2:4]) AS INT) AS n, CAST(embedding[2] AS DOUBLE) AS second FROM embeddings",
    "vectors": "SELECT vec_id, round(sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE), 6) AS length, round(embedding[1]::DOUBLE * 2, 6) AS x2 FROM embeddings",
    "unit_measure": "SELECT p_partkey, (p_partkey // 8) || ' mi ' || (p_partkey % 8 * 660) || ' ft 0 in' AS text FROM part",
    "language_alternatives": "SELECT source, string_agg(lang || '=' || v, ',' ORDER BY lang <> 'x-default', lang) AS langs FROM (SELECT source, CASE lang WHEN 'en' THEN 'x-default' ELSE lang END AS lang, CAST(max(doc_id) AS VARCHAR) AS v FROM documents GROUP BY 1, 2) GROUP BY source",
    "archive_claims": "SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 THEN CAST(p_size % 4 + 1 AS INT) ELSE 0 END AS part, CASE WHEN p_partkey % 7 < 5 THEN ['A', 'B', 'U', 'e', 'f'][p_partkey % 7 + 1] ELSE '' END AS conformance FROM part",
    "signature_digest": "SELECT doc_id, sha256(array_slice(encode(text), 1, 100) || array_slice(encode(text), 151, 1073741974)) AS sha256, sha1(text) AS sha1 FROM documents",
    "aes_content": "SELECT doc_id, md5(text) AS md5, CAST(16 + (octet_length(encode(text)) // 16 + 1) * 16 AS INT) AS sealed FROM documents",
    "xfdf_export": """SELECT n_regionkey, '<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>' || string_agg('<field name="' || n_name || '"><value>&lt;' || n_name || '&amp;&gt;</value></field>', '' ORDER BY n_name) || '</fields></xfdf>' AS xfdf FROM nation GROUP BY n_regionkey""",
    "xfdf_import": "SELECT c_custkey, 'name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment & more', c_mktsegment FROM customer",
    "fdf_import": "SELECT c_custkey, 'who.name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'who.at', c_mktsegment FROM customer",
    "xmp_properties": """SELECT p_partkey, 'Producer' AS property, '' AS container, 0 AS place, '' AS lang, 'q' AS value FROM part UNION ALL SELECT p_partkey, 'size', '', 0, '', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT p_partkey, 'title', 'Alt', 0, 'x-default', p_brand FROM part UNION ALL SELECT p_partkey, 'title', 'Alt', 1, 'de', p_type FROM part""",
    "layout_exact": f"""WITH {RUNS_SQL}, g AS (SELECT doc_id, page_idx, line_idx, coalesce(x - lag(x + width) OVER w > 0.4 * 12, false) AS b, row_number() OVER w AS k, x, y FROM runs WINDOW w AS (PARTITION BY doc_id, page_idx, line_idx ORDER BY x, word_idx)),
s AS (SELECT doc_id, page_idx, coalesce(lag(y) OVER p - y > 12, true) AS start FROM g WHERE k = 1 WINDOW p AS (PARTITION BY doc_id, page_idx ORDER BY line_idx))
SELECT doc_id, page_idx, CAST(l AS INT) AS lines, CAST(r AS INT) AS runs, b AS breaks, n AS paragraphs FROM (SELECT doc_id, page_idx, count(*) AS r, count(DISTINCT line_idx) AS l, count(*) FILTER (b) AS b FROM g GROUP BY ALL) JOIN (SELECT doc_id, page_idx, count(*) FILTER (start) AS n FROM s GROUP BY ALL) USING (doc_id, page_idx)""",
    "xref_totals": "SELECT doc_id, CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents",
}
