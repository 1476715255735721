"""Queries that apply the calculator, the function objects and the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import calc, codecs
from quire.functions import scalars as S
from quire.session import spread, table

#: name: (program over quantity and price, DuckDB expression over q and p).
PROGRAMS = {
    "abs": ("sub abs", "abs(q - p)"), "add": ("add", "q + p"), "sub": ("sub", "q - p"), "mul": ("mul", "q * p"), "div": ("div", "q / p"),
    "idiv": ("exch idiv", "trunc(trunc(p) / trunc(q))"), "mod": ("exch mod", "trunc(p) % trunc(q)"), "neg": ("add neg", "-(q + p)"),
    "ceiling": ("div 100 mul ceiling", "ceil(q / p * 100)"), "floor": ("exch div floor", "floor(p / q)"), "round": ("exch div round", "floor(p / q + 0.5)"), "truncate": ("sub 7 div truncate", "trunc((q - p) / 7)"),
    "cvi": ("sub 3 div cvi", "trunc((q - p) / 3)"), "cvr": ("pop cvr", "q"), "sin": ("pop sin", "sin(radians(q))"), "cos": ("pop cos", "cos(radians(q))"), "atan": ("sub 25 atan", "CASE WHEN degrees(atan2(q - p, 25)) < 0 THEN degrees(atan2(q - p, 25)) + 360 ELSE degrees(atan2(q - p, 25)) END"),
    "exp": ("pop 1.5 exp", "pow(q, 1.5)"), "ln": ("exch pop ln", "ln(p)"), "log": ("exch pop log", "log10(p)"), "sqrt": ("add sqrt", "sqrt(q + p)"),
    "and": ("cvi exch cvi and", "(trunc(q)::BIGINT & trunc(p)::BIGINT)::DOUBLE"), "or": ("cvi exch cvi or", "(trunc(q)::BIGINT | trunc(p)::BIGINT)::DOUBLE"), "xor": ("cvi exch cvi xor", "xor(trunc(q)::BIGINT, trunc(p)::BIGINT)::DOUBLE"), "not": ("pop not", "-q"),
    "bitshift": ("exch pop cvi -3 bitshift", "(trunc(p)::BIGINT >> 3)::DOUBLE"), "eq": ("pop cvi 2 mod 0 eq {1} {0} ifelse", "CASE WHEN trunc(q) % 2 = 0 THEN 1.0 ELSE 0.0 END"), "ne": ("pop 25 ne {1} {0} ifelse", "CASE WHEN q <> 25 THEN 1.0 ELSE 0.0 END"),
    "gt": ("pop 25 gt {1} {0} ifelse", "CASE WHEN q > 25 THEN 1.0 ELSE 0.0 END"), "ge": ("pop 25 ge {1} {0} ifelse", "CASE WHEN q >= 25 THEN 1.0 ELSE 0.0 END"), "lt": ("pop 25 lt {1} {0} ifelse", "CASE WHEN q < 25 THEN 1.0 ELSE 0.0 END"), "le": ("pop 25 le {1} {0} ifelse", "CASE WHEN q <= 25 THEN 1.0 ELSE 0.0 END"),
    "true": ("pop true {2 mul} if", "q * 2"), "false": ("pop false {2 mul} if", "q"), "dup": ("pop dup mul", "q * q"), "exch": ("exch sub", "p - q"), "pop": ("pop", "q"), "copy": ("2 copy add mul add", "q + p * (q + p)"),
    "index": ("1 index sub add", "q + (p - q)"), "roll": ("3 3 1 roll sub mul", "3 * (q - p)"), "if": ("pop dup 30 gt {30 sub} if", "CASE WHEN q > 30 THEN q - 30 ELSE q END"), "ifelse": ("2 copy lt {exch} if sub", "abs(q - p)"),
}


def _program(name):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        value = calc.compile_program(PROGRAMS[name][0], F.col("l_quantity"), F.col("l_extendedprice") / 1000)[-1]
        return li.select("l_orderkey", "l_linenumber", F.round(value.cast("double"), 6).alias("value"))

    return run


def _li(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))


def fn_type0_sampled(spark, sf):
    return _li(spark, sf).select("l_orderkey", "l_linenumber", F.round(calc.sampled(F.col("q"), (0.0, 60.0), [0, 64, 255, 128, 16], (0.0, 1.0)), 6).alias("value"))


def fn_type2_exponential(spark, sf):
    a, b = calc.exponential(F.col("d"), [0.0, 1.0], [1.0, 0.25], 2.0, [(0.0, 0.005), (0.0, 1.0)])
    return _li(spark, sf).select("l_orderkey", "l_linenumber", F.round(a, 6).alias("c0"), F.round(b, 6).alias("c1"))


def fn_type3_stitching(spark, sf):
    parts = [lambda x: x * 2, lambda x: 1 - x]
    return _li(spark, sf).select("l_orderkey", "l_linenumber", F.round(calc.stitching(F.col("q"), (0.0, 50.0), [20.0], [(0.0, 1.0), (1.0, 0.0)], parts), 6).alias("value"))


def hex_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", F.lower(F.hex("b")).alias("hex"), F.md5(S.hex_decode(F.hex("b"))).alias("back"))


def base64_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", F.regexp_replace(F.base64("b"), r"\s", "").alias("b64"), F.md5(F.unbase64(F.base64("b"))).alias("back"))


def bom_decode(spark, sf):
    return _marked(spark, sf, F.col("text"))


def _marked(spark, sf, t):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8")))
    return table(spark, sf, "documents").select("doc_id", S.decode_by_mark(marked).alias("text"))


def date_parse(spark, sf):
    raw = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.when(F.col("event_id") % 2 == 0, F.lit("+02'30'")).otherwise(F.lit("Z")))
    return table(spark, sf, "events").select("event_id", F.date_format(S.parse_date(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


def date_format(spark, sf):
    return table(spark, sf, "events").select("event_id", S.format_date("ts").alias("iso"))


def float_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.format_number(F.col("o_totalprice"), 1).alias("text"))


def md_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.escape_markdown("text").alias("text"))


def html_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.escape_html("text").alias("text"))


def html_title_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


def digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def roman_numerals(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.roman("p_partkey").alias("roman"), S.letters(F.col("p_size")).alias("letters"))


def uri_scheme(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


def tokenize_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\s|\S+"), F.lit(0))).alias("parts"), F.size(F.split("text", r"\s", -1)).alias("fields"))


def matrix_transform(spark, sf):
    m = [F.col("embedding")[i].cast("double") for i in range(6)]
    return table(spark, sf, "embeddings").select("vec_id", F.round(m[0] * 3 + m[2] * 4 + m[4], 6).alias("x"), F.round(m[1] * 3 + m[3] * 4 + m[5], 6).alias("y"))


def cmyk_to_rgb(spark, sf):
    li = table(spark, sf, "lineitem")
    r, g, b = S.rgb_of_cmyk(F.col("l_discount"), F.col("l_tax"), F.lit(0.5), F.lit(0.55))
    return li.select("l_orderkey", "l_linenumber", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


def xmp_integer(spark, sf):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("+"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 4 == 1, F.lit("12x")).otherwise(F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.cast("int")).alias("value"))


def rational(spark, sf):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.round(S.rational(raw), 6).alias("value"))


def map_accessors(spark, sf):
    m = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("none"), F.lit("")), lambda k, v: v != "")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), F.element_at(m, "lang").alias("lang"))


def flate_ascii85_roundtrip(spark, sf):
    raw = F.encode("text", "UTF-8")
    d = spread(table(spark, sf, "documents")).select("doc_id", raw.alias("b"))
    out = d.select("doc_id", "b", codecs.encode_column(codecs.encode_column(F.col("b"), "Fl"), "A85").alias("e"))
    back = out.select("doc_id", codecs.decode_column(F.col("e"), "ASCII85Decode", "FlateDecode").alias("back"))
    return back.select("doc_id", F.md5("back").alias("md5"), F.octet_length("back").cast("long").alias("n"))


def lzw_runlength_roundtrip(spark, sf):
    d = spread(table(spark, sf, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    e = d.select("doc_id", "b", codecs.encode_column(codecs.encode_column(F.col("b"), "LZW"), "RL").alias("e"))
    back = e.select("doc_id", codecs.decode_column(F.col("e"), "RunLengthDecode", "LZWDecode").alias("back"))
    return back.select("doc_id", F.md5("back").alias("md5"), F.octet_length("back").cast("long").alias("n"))


QUERIES = {f"calc_{n}": _program(n) for n in PROGRAMS} | {f.__name__: f for f in (fn_type0_sampled, fn_type2_exponential, fn_type3_stitching, hex_roundtrip, base64_roundtrip, bom_decode, date_parse, date_format, float_format, md_escape, html_escape, html_title_text, digest, roman_numerals, uri_scheme, tokenize_spaces, matrix_transform, cmyk_to_rgb, xmp_integer, rational, map_accessors, flate_ascii85_roundtrip, lzw_runlength_roundtrip)}

_ROMAN = "p_partkey // 1000"
SQL = {f"calc_{n}": f"SELECT l_orderkey, l_linenumber, round(CAST({e} AS DOUBLE), 6) AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem)" for n, (_, e) in PROGRAMS.items()} | {
    "fn_type0_sampled": "WITH s AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 0), 60) * (4 / 60.0::DOUBLE) AS pt, [0, 64, 255, 128, 16] AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round((t[i + 1] + (pt - i) * (t[i + 2] - t[i + 1])) * (1 / 255.0::DOUBLE), 6) AS value FROM (SELECT *, CAST(least(floor(pt), 3) AS INT) AS i FROM s)",
    "fn_type2_exponential": "SELECT l_orderkey, l_linenumber, round(least(greatest(pow(l_discount, 2), 0), 0.005), 6) AS c0, round(least(greatest(1 - 0.75 * pow(l_discount, 2), 0), 1), 6) AS c1 FROM lineitem",
    "fn_type3_stitching": "SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 20 THEN x * (1 / 20.0::DOUBLE) * 2 ELSE 1 - (1 - (x - 20) * (1 / 30.0::DOUBLE)) END, 6) AS value FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 0), 50) AS x FROM lineitem)",
    "hex_roundtrip": "SELECT doc_id, lower(hex(encode(text))) AS hex, md5(text) AS back FROM documents",
    "base64_roundtrip": "SELECT doc_id, base64(encode(text)) AS b64, md5(text) AS back FROM documents",
    "bom_decode": "SELECT doc_id, text FROM documents",
    "date_parse": "SELECT event_id, strftime(date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "date_format": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events",
    "float_format": "WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT) AS s FROM orders) SELECT o_orderkey, CAST(s // 10 AS VARCHAR) || CASE WHEN s % 10 = 0 THEN '' ELSE '.' || (s % 10) END AS text FROM s",
    "md_escape": r"SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<>#|])', '\\\1', 'g') AS text FROM documents",
    "html_escape": "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM documents",
    "html_title_text": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    "digest": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "roman_numerals": "SELECT p_partkey, repeat('m', CAST(p_partkey // 1000 AS INT)) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][CAST(p_partkey // 100 % 10 AS INT) + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(p_partkey // 10 % 10 AS INT) + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(p_partkey % 10 AS INT) + 1] AS roman, repeat(chr(97 + (p_size - 1) % 26), (p_size + 25) // 26) AS letters FROM part",
    "uri_scheme": "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages",
    "tokenize_spaces": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\s|\S+')) AS INT) AS parts, CAST(len(regexp_split_to_array(text, '\s')) AS INT) AS fields FROM documents",
    "matrix_transform": "SELECT vec_id, round(embedding[1]::DOUBLE * 3 + embedding[3]::DOUBLE * 4 + embedding[5]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE * 3 + embedding[4]::DOUBLE * 4 + embedding[6]::DOUBLE, 6) AS y FROM embeddings",
    "cmyk_to_rgb": "SELECT l_orderkey, l_linenumber, round(1 - least(1, l_discount + 0.55), 6) AS r, round(1 - least(1, l_tax + 0.55), 6) AS g, 0.0::DOUBLE AS b FROM lineitem",
    "xmp_integer": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_partkey AS INT) END AS value FROM part",
    "rational": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_size / CAST(p_partkey % 5 AS DOUBLE), 6) END AS value FROM part",
    "map_accessors": "SELECT doc_id, concat_ws(',', CASE WHEN lang <> '' THEN 'lang' END, CASE WHEN source <> '' THEN 'source' END) AS keys, lang FROM documents",
    "flate_ascii85_roundtrip": "SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents",
    "lzw_runlength_roundtrip": "SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents",
}
