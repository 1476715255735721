"""Merged graphs, pointer jumping, repaired forms, byte tables, sampled grids and variants against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import calc, getters, xref
from quire.operators import clone, fields, ranks, trees
from quire.sources import objects as O


def test_topmost_of_chains_trees_and_cycles(spark):
    rng = random.Random(4)
    parent = {i: (rng.randrange(i) if i % 40 else None) for i in range(1, 400)} | {0: None}
    parent |= {i: i - 1 for i in range(1001, 1200)} | {1000: None}  # one long chain
    parent |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 2004: 2003, 2005: 2005, 3000: 9999}  # circles, what hangs on them, a lost parent

    def top(n):
        seen, d = set(), 0
        while n in parent and n not in seen:
            if parent[n] is None:
                return n, d
            seen.add(n)
            n, d = parent[n], d + 1
        return None, None

    df = spark.createDataFrame(list(parent.items()) + [(None, 1)], "node int, parent int").repartition(3)
    assert {r.node: (r.top, r.depth) for r in trees.topmost(df).collect()} == {n: top(n) for n in parent}
    assert trees.topmost(df.limit(0)).collect() == []


def test_walks_of_any_size_and_several_parents(spark):
    nodes = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("c", "a", "c"), ("d", "b", "d"), ("d", "c", "d"), ("b", "d", "b")], "node string, parent string, name string")
    assert sorted(r.path for r in trees.walk(nodes).collect()) == ["a", "a.b", "a.b.d", "a.c", "a.c.d", "a.c.d.b"]
    deep = spark.range(30).selectExpr("id AS node", "IF(id = 0, NULL, id - 1) AS parent", "'x' AS name")
    assert trees.walk(deep).agg(F.max("depth")).first()[0] == 29
    with pytest.raises(RuntimeError):
        trees.walk(deep, max_depth=7)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_numbers_of_sparse_and_hashed_ids(spark, size):
    rng = random.Random(size)
    keys = [rng.choice([rng.getrandbits(62) - (1 << 61), rng.randrange(50), None]) for _ in range(300)]
    rows = [(rng.randrange(3), k) for k in keys]
    df = spark.createDataFrame(rows, "lead int, id long").repartition(4)
    got = sorted((r.n, r.lead, r.id) for r in ranks.numbered(df, ["lead", "id"], "n", size).collect())
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]
    once = sorted({k for k in keys if k is not None})
    sums = {r.id: r.s for r in ranks.running(spark.createDataFrame([(k, 2) for k in once], "id long, v long"), "id", "v", "s", size).collect()}
    assert sums == {k: 2 * i for i, k in enumerate(once)}


def test_repaired_fields(spark):
    nodes = spark.createDataFrame([(1, 1, None, "A"), (1, 2, 1, "k"), (1, 3, 2, "k"), (1, 4, None, "A"), (1, 5, 6, "c"), (1, 6, 5, "c"), (2, 1, None, "A"), (1, 7, 99, "lost"), (1, 8, None, None)], "doc int, node int, parent int, name string")
    widgets = spark.createDataFrame([(1, 5, 100, 4, "w"), (1, 3, 101, 3, "w"), (1, 4, 102, None, "A"), (1, 6, 103, None, "A"), (1, 1, 104, 5, "w"), (2, 1, 105, 1, "w"), (3, 1, 106, None, "w"), (1, 2, 107, 7, "w"), (1, 9, 108, 8, "w")], "doc int, ord int, widget int, parent int, name string")
    ready = spark.createDataFrame([(1,), (1,), (2,)], "doc int")
    got = sorted(map(tuple, fields.repaired(widgets, nodes, ready).collect()), key=str)
    # doc 1: widget 101's topmost is 1, which takes the name A from 4; doc 3 has no resources
    assert got == sorted([(1, 3, 1, "A"), (1, 4, 102, "A"), (1, 6, 103, "A"), (1, 9, 8, None), (2, 1, 1, "A")], key=str)
    assert fields.repaired(widgets.limit(0), nodes, ready).collect() == []


def test_role_chains(spark):
    roles = spark.createDataFrame([("a", "b"), ("b", "P"), ("x", "y"), ("y", "x"), ("z", "x"), ("b", "Q"), (None, "P"), ("n", None)], "role string, to string")
    elements = spark.createDataFrame([(i, r) for i, r in enumerate(["a", "b", "P", "x", "z", "other", None, "n", "a"])], "id int, role string")
    assert {r.id: r.standard for r in fields.standard_roles(elements, roles).collect()} == dict(enumerate(["P", "P", "P", "x", "z", "other", None, "n", "P"]))


def merged_by_hand(source, target):
    """The target with the source merged in, by recursion over lists and dictionaries that may be shared and circular."""
    clones, seen = {}, set()

    def copy(v):
        if isinstance(v, (dict, list)):
            if id(v) not in clones:
                clones[id(v)] = out = type(v)()
                if isinstance(v, dict):
                    out.update({k: copy(x) for k, x in v.items()})
                else:
                    out.extend(copy(x) for x in v)
            return clones[id(v)]
        return v

    todo = [(source, target)]
    while todo:
        s, t = todo.pop(0)
        if (id(s), id(t)) in seen:
            continue
        seen.add((id(s), id(t)))
        if isinstance(s, list) and isinstance(t, list):
            t.extend(copy(x) for x in s)
        elif isinstance(s, dict) and isinstance(t, dict):
            for k, v in s.items():
                if k in t:
                    todo.append((v, t[k]))
                else:
                    t[k] = copy(v)
    return target


def rows_of(root, doc):
    nodes, entries, names = [], [], {}

    def name(v):
        if isinstance(v, (dict, list)):
            if id(v) not in names:
                names[id(v)] = f"n{len(names):03d}"
                nodes.append((doc, names[id(v)], "dict" if isinstance(v, dict) else "array", None))
                for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                    entries.append((doc, names[id(v)], k if isinstance(v, dict) else None, None if isinstance(v, dict) else k, name(x)))
            return names[id(v)]
        nodes.append((doc, f"v{len(nodes):03d}", "text", str(v)))
        return nodes[-1][1]

    return name(root), nodes, entries


def rebuilt(nodes, entries, root):
    kinds, held, made = {n: (k, v) for _, n, k, v in nodes}, {}, {}
    for _, n, key, idx, child in entries:
        held.setdefault(n, []).append((key if key is not None else idx, child))

    def value(n):
        kind, v = kinds[n]
        if kind == "text":
            return v
        if n not in made:
            made[n] = out = {} if kind == "dict" else []
            for k, c in sorted(held.get(n, [])):
                if kind == "dict":
                    out[k] = value(c)
                else:
                    assert k == len(out)
                    out.append(value(c))
        return made[n]

    return value(root)


def drawn(v, depth=7):
    """A value as text, cut where it goes deeper."""
    if depth == 0:
        return "..."
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{drawn(v[k], depth - 1)}" for k in sorted(v)) + "}"
    return "[" + ",".join(drawn(x, depth - 1) for x in v) + "]" if isinstance(v, list) else str(v)


def graph(rng):
    parts = [{} if rng.random() < 0.6 else [] for _ in range(rng.randint(3, 9))]
    parts[0] = {}
    for p in parts:
        for _ in range(rng.randint(0, 5)):
            v = rng.choice([rng.choice(parts), rng.choice(parts), rng.randrange(100)])
            if isinstance(p, dict):
                p[rng.choice("abcdef")] = v
            else:
                p.append(v)
    return parts[0]


def test_merged_graphs(spark):
    rng = random.Random(12)
    s_rows, t_rows, roots, want = ([], []), ([], []), [], {}
    for doc in range(40):
        s, t = graph(rng), graph(rng)
        (a, n, e), (b, m, g) = rows_of(s, doc), rows_of(t, doc)
        roots.append((doc, a, b))
        for held, more in zip((*s_rows, *t_rows), (n, e, m, g)):
            held.extend(more)
        want[doc] = merged_by_hand(s, t)
    kinds = ("doc int, node string, kind string, value string", "doc int, node string, key string, idx long, child string")
    source, target = (tuple(spark.createDataFrame(r, k).repartition(2) for r, k in zip(rows, kinds)) for rows in (s_rows, t_rows))
    nodes, entries = clone.merged(source, target, spark.createDataFrame(roots, "doc int, s string, t string"))
    nodes, entries = nodes.collect(), entries.select("doc", "node", "key", "idx", "child").collect()
    same = 0
    for doc, _, b in roots:
        got = rebuilt([r for r in nodes if r.doc == doc], [r for r in entries if r.doc == doc], f"t:{b}")
        # where several source arrays meet one target array, only their order may differ
        same += drawn(got) == drawn(want[doc])
        flat = lambda v: sorted(drawn(v, 3))
        assert flat(got) == flat(want[doc]), doc
    assert same > 30


def test_cross_reference_streams_like_the_reader(spark):
    held = {n: {"K": n} for n in range(1, 40)} | {50: O.flate(b"x" * 900), 51: O.flate(b"y")}
    data = O.write(held, 1, packed=7)
    file = O.File.open(data)
    number = max(n for n, w in file.where.items() if w[0] == "at")
    stream = file.get(O.Ref(number))
    rows = [(1, bytearray(stream.data()), stream.head["W"], stream.head["Index"]), (2, None, [1, 2, 1], [0, 1]), (3, bytearray(b"\x01\x00\x09\x05\x02\x00"), [1, 2, 1], [5, 9]), (4, bytearray(b"\x00\x10\x00\x20"), [0, 2, 0], [3, 2]), (5, bytearray(b""), [0, 0, 0], [0, 1]), (6, bytearray(b"\x01"), [1], [0, 1])]
    df = spark.createDataFrame(rows, "doc int, data binary, w array<int>, i array<int>")
    got = {(r.doc, r.num): (r.place, r.at, r.third) for r in xref.stream_rows(df, ["doc"], "data", "w", "i").collect()}
    assert {n: w for (d, n), w in got.items() if d == 1} == {n: (w[0], w[1], w[2] if w[0] == "in" else 0) for n, w in file.where.items()}
    assert {k: v for k, v in got.items() if k[0] > 1} == {(3, 5): ("at", 9, 5), (4, 3): ("at", 16, 0), (4, 4): ("at", 32, 0)}


def test_bits(spark):
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(40))
    whole = int.from_bytes(data, "big")
    cases = [(i, a, w) for i, (a, w) in enumerate((rng.randrange(320), rng.randrange(57)) for _ in range(400))]
    df = spark.createDataFrame(cases, "i int, a int, w int").withColumn("d", F.lit(data))
    got = {r.i: r.v for r in df.select("i", xref.bits(F.col("d"), F.col("a"), F.col("w")).alias("v")).collect()}
    for i, a, w in cases:
        if w + a % 8 <= 56:
            assert got[i] == (0 if w == 0 else None if a + w > 320 else (whole >> (320 - a - w)) & ((1 << w) - 1)), (a, w)


def test_grids_of_any_dimension(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 4):
        size = [rng.randint(1, 4) for _ in range(n)]
        points = 1
        for k in size:
            points *= k
        samples = [[rng.randrange(256), rng.randrange(256)] for _ in range(points)]
        domain, encode = [(-1.0, 2.0)] * n, [(rng.choice([0.0, k - 1.0]), rng.uniform(0, k)) for k in size]
        inputs = [tuple(rng.uniform(-2, 3) for _ in range(n)) for _ in range(40)] + [tuple([2.0] * n), tuple([None] + [0.0] * (n - 1))]

        def plain(xs, k):
            at = [min(max(e0 + (min(max(x, -1.0), 2.0) + 1) * (e1 - e0) / 3.0, 0.0), s - 1.0) for x, (e0, e1), s in zip(xs, encode, size)]
            total = 0.0
            for corner in range(1 << n):
                weight, index, stride = 1.0, 0, 1
                for i, a in enumerate(at):
                    up = corner >> i & 1
                    weight *= (a - int(a)) if up else 1 - (a - int(a))
                    index += min(int(a) + up, size[i] - 1) * stride
                    stride *= size[i]
                total += weight * samples[index][k]
            return [min(max(y, -0.5), 0.9) for y in (-1 + total * 2 / 255, total * 3 / 255)][k]

        df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x struct<{', '.join(f'x{j}: double' for j in range(n))}>")
        out = calc.sampled_grid([F.col(f"x.x{j}") for j in range(n)], domain, size, samples, [(-1, 1), (0, 3)], encode=encode, limits=[(-0.5, 0.9)] * 2)
        for r in df.select("i", out[0].alias("a"), out[1].alias("b")).collect():
            xs = inputs[r.i]
            assert (r.a, r.b) == ((None, None) if None in xs else pytest.approx((plain(xs, 0), plain(xs, 1))))
    with pytest.raises(ValueError):
        calc.sampled_grid([F.lit(0.0)], [(0, 1)], [3], [[1]], [(0, 1)])


def test_variant_getters(spark):
    text = '{"a": {"b\'c": [1, 2.5, "3", true, null]}, "s": "x", "big": 12345678901234567890123}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, "[]")], "id int, t string").select("id", getters.parsed(F.col("t")).alias("v"))
    v, at = F.col("v"), ("a", "b'c")
    row = {r.id: r for r in df.select("id", getters.get(v, "int", 7, *at, 0).alias("i"), getters.get(v, "int", 7, *at, 1).alias("cut"), getters.get(v, "int", 7, *at, 2).alias("text"), getters.get(v, "double", 0.5, *at, 1).alias("d"), getters.get(v, "boolean", False, *at, 3).alias("f"), getters.get(v, "string", "?", *at, 4).alias("none"), getters.get(v, "string", "?", "s").alias("s"), getters.get(v, "long", -1, "big").alias("big"), getters.size(v, *at).alias("n"), getters.size(v).alias("top"), F.coalesce(getters.has(v, *at, 4), F.lit(False)).alias("has")).collect()}
    assert tuple(row[1])[1:] == (1, 2, 7, 2.5, True, "?", "x", -1, 5, 0, True)
    assert all(tuple(row[k])[1:] == (7, 7, 7, 0.5, False, "?", "?", -1, 0, 0, False) for k in (2, 3, 4))
    with pytest.raises(ValueError):
        getters.path("both ' and \"")


def test_chains_of_actions(spark):
    import json

    from quire.operators import actions

    rng = random.Random(9)

    def action(depth):
        out = {"S": rng.choice(["URI", "GoTo", "Named", "JavaScript", "Launch", "Nothing", None]), "URI": "u", "D": "d", "N": "n", "JS": "s", "F": rng.choice(["f", {"F": "g"}, {}, 7])}
        if depth and rng.random() < 0.8:
            out["Next"] = rng.choice([action(depth - 1), [action(depth - 1) for _ in range(rng.randint(0, 3))], None, "no"])
        return out

    def plain(a, depth=0):
        if not isinstance(a, dict) or a.get("S") not in actions.KINDS:
            return
        file = a["F"] if isinstance(a["F"], str) else a["F"].get("F") if isinstance(a["F"], dict) else None
        yield depth, a["S"], "u" if a["S"] == "URI" else None, "d" if a["S"] == "GoTo" else None, file if a["S"] == "Launch" else None, "n" if a["S"] == "Named" else None
        for x in a.get("Next") if isinstance(a.get("Next"), list) else [a.get("Next")]:
            yield from plain(x, depth + 1)

    trees_ = [action(4) for _ in range(60)]
    rows = [(i, json.dumps(a)) for i, a in enumerate(trees_)] + [(100, "[]"), (101, "broken"), (102, None)]
    df = spark.createDataFrame(rows, "id int, t string").select("id", getters.parsed(F.col("t")).alias("v"))
    got = actions.chain(df, ["id"], "v").collect()
    want = [(i, n, *x) for i, a in enumerate(trees_) for n, x in enumerate(plain(a))]
    assert sorted((r.id, r.ord, r.depth, r.kind, r.uri, r.dest, r.file, r.named) for r in got) == sorted(want) and len(want) > 60
