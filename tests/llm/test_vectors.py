"""Exact search and hard negatives against all pairs by brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import negatives, topk, vectors


def score(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


def takes_part(r, labelled=False):
    return r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and not (labelled and r[2] is None)


def brute_topk(rows, k, every):
    rows = [r for r in rows if takes_part(r)]
    out = []
    for q in {(r[0], tuple(r[1])) for r in rows if r[0] % every == 0}:
        found = sorted((-score(q[1], c[1]), c[0]) for c in rows if c[0] != q[0])[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def brute_negatives(rows, every, positives, k, low, high):
    rows = [r for r in rows if takes_part(r, True)]
    out = []
    for a in {(r[0], tuple(r[1]), r[2]) for r in rows if r[0] % every == 0}:
        first = sorted((-score(a[1], c[1]), c[0]) for c in rows if c[2] == a[2] and c[0] != a[0])[:positives]
        other = sorted((-score(a[1], c[1]), c[0]) for c in rows if c[2] != a[2])
        for p, i in first:
            fit = [(s, j) for s, j in other if low * -p <= 100 * -s <= high * -p][:k]
            out += [(a[0], i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


def odd_rows(seed, n=160, d=6):
    """Clusters, copies, ties, zeros, shorter and empty vectors, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(d)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.1) for x in c] if i % 3 else [rng.choice([0.0, 0.25, -0.25]) for _ in range(d)]
        if i % 11 == 0:
            v = list(centres[0])  # a large group of copies
        rows.append([i, v, rng.choice([0, 1, 1, 2])])
    rows[7][1], rows[8][1], rows[9][1], rows[10][2] = None, [0.1, None, 0.2], [math.nan, 1.0], None
    rows[13][1], rows[14][1], rows[15][1], rows[20][1], rows[25][1] = [math.inf], [], [0.5], [0.5] * (d + 3), [-0.0] * d
    rows.append([None, [1.0] * d, 1])
    rows += [list(rows[30]), list(rows[31]), list(rows[30]), [30, [0.3] * d, 2]]  # repeated rows, and an id with two vectors
    return [tuple(r) for r in rows]


def frame(spark, rows):
    kept = [(*r, "own", 5) for r in rows]
    return spark.createDataFrame(kept, "vec_id long, embedding array<double>, label int, score string, rank int").repartition(3)


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 64), (3, 2048)])
def test_search_like_brute_force(spark, seed, block):
    rows = odd_rows(seed)
    df = frame(spark, rows)
    got = topk.search(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 4, block_rows=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 4, 5)
    assert topk.search(df.limit(0), df.limit(0), "vec_id", "embedding", 4).collect() == []


def test_fewer_rows_than_asked(spark):
    rows = [(0, [1.0], 1), (5, [0.5], 1), (6, [2.0], 2)]
    df = frame(spark, rows)
    assert sorted(map(tuple, topk.search(df, df, "vec_id", "embedding", 5).collect())) == brute_topk(rows, 5, 1)
    one = df.where("vec_id = 0")
    assert topk.search(one, one, "vec_id", "embedding", 5).collect() == []


@pytest.mark.parametrize("seed,block", [(1, 9), (2, 60), (3, 2048)])
def test_negatives_like_brute_force(spark, seed, block):
    rows = odd_rows(seed)
    df = frame(spark, rows)
    for low, high in ((50, 95), (-40, 100)):
        got = negatives.mine(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", "label", 5, 3, low, high, block_rows=block)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 5, 3, low, high)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(df.limit(0), df, "vec_id", "embedding", "label", 5, 3, 50, 95).collect() == []


def test_trees_prune_and_lose_nothing():
    """Windows over clustered rows in one block: same hits as a scan, with most leaves never opened."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-150, 150, (12, 8))
    x = np.concatenate([c + rng.integers(-3, 4, (100, 8)) for c in centres])
    labels, ids = np.arange(len(x)) % 3, rng.permutation(len(x))
    flat, starts = x.ravel(), np.arange(0, x.size + 1, 8)
    block = {k: vectors.unpacked(vectors.packed(v)) for k, v in negatives.tree(labels, ids, flat, starts, leaf=16).items()}
    asked = negatives.asked_for(ids[:40], labels[:40], ids[:40], flat[: 40 * 8], starts[:41])
    search = negatives.Search(block, asked)
    anchor, top = np.arange(40), (x[:40] @ x.T).max(axis=1)
    low, high = top // 4, top // 2
    i, got, s = search.best(anchor, low, high, labels[:40], False, ids[:40], 3)
    want = set()
    for a in range(40):
        all_of = sorted((-int(v), int(ids[r])) for r, v in enumerate(x @ x[a]) if labels[r] != labels[a] and low[a] <= v <= high[a])
        want |= {(a, j, -v) for v, j in all_of[:3]}
    assert set(zip(i.tolist(), got.tolist(), s.tolist())) == want
    assert search.pruned > search.visited / 4
    leaves = block["left"] < 0
    assert (block["to"] - block["from"])[leaves].max() <= 16 or block["radius"][leaves].max() > 0
    for f, t, c, r, lab in zip(block["from"], block["to"], block["centre"].reshape(-1, 8), block["radius"], block["label"]):
        part = block["rows"].reshape(-1, 8)[f:t]
        assert (np.sqrt(((part - c) ** 2).sum(axis=1)) <= r + 1e-9).all() and (block["labels"][f:t] == lab).all()


def test_postings_hold_every_component():
    rng = random.Random(6)
    rows = [[rng.choice([0, 0, 3, -7]) for _ in range(rng.randint(0, 9))] for _ in range(50)]
    ids = np.array(rng.sample(range(1000), 50))
    block = topk.postings(ids, np.array([x for r in rows for x in r]), np.cumsum([0, *map(len, rows)]))
    got = defaultdict(dict)
    for j, t in enumerate(block["terms"]):
        for r, w in list(zip(block["rows"], block["weights"]))[block["starts"][j] : block["starts"][j + 1]]:
            got[int(block["ids"][r])][int(t)] = int(w)
    assert got == {int(i): {t: w for t, w in enumerate(r) if w} for i, r in zip(ids, rows) if any(r)}


def test_large_components(spark):
    rows = [(0, [2.0**25, 1.0], 1), (1, [2.0**20, -1.0], 1), (2, [3.0, 2.0], 2), (3, [2.0**19, 0.0], 2)]
    df = frame(spark, rows)
    assert sorted(map(tuple, topk.search(df, df, "vec_id", "embedding", 3, scale=16.0).collect())) == sorted(
        (q[0], n + 1, j, -s) for q in rows for n, (s, j) in enumerate(sorted((-sum(math.floor(16 * x) * math.floor(16 * y) for x, y in zip(q[1], c[1])), c[0]) for c in rows if c[0] != q[0]))
    )
    huge = frame(spark, [(0, [1e12], 1), (1, [1e12], 1)])
    with pytest.raises(Exception, match="63 bits"):
        topk.search(huge, huge, "vec_id", "embedding", 1).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whole_tables(spark, sf):
    at = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    ids = np.array([r.vec_id for r in rows])
    label = np.array([(r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in rows])
    top, mined = [], []
    for a in np.flatnonzero(ids % 50 == 0):
        s = x @ x[a]
        order = [j for j in np.lexsort((ids, -s)) if j != a]
        top += [(ids[a], n + 1, ids[j], s[j]) for n, j in enumerate(order[:5])]
        for p in [j for j in order if label[j] == label[a]][:5]:
            fit = [j for j in order if label[j] != label[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            mined += [(ids[a], ids[p], n + 1, ids[j], s[p], s[j]) for n, j in enumerate(fit)]
    assert sorted(map(tuple, topk.op12(spark, at).collect())) == sorted(top)
    assert sorted(map(tuple, negatives.op13(spark, at).collect())) == sorted(mined)
