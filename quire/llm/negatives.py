"""Operator 13, hard-negative mining: ball trees bound inner products above and below."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, table
from quire.llm.vectors import BLOCK_ROWS, QUERY_ROWS, first_of, fits, in_blocks, meet, taking_part

#: Rows of a leaf, at most (rows of one place stay together).
LEAF = 64
TREE = ["ids", "labels", "shape", "rows", "from", "to", "left", "right", "label", "radius", "centre"]
ASKED = ["ids", "keys", "labels", "shape", "rows"]
#: Relative slack of the bounds, far above the rounding of doubles.
SLACK = 1e-9
#: A score beneath and one above all others.
NONE, MOST = -np.iinfo(np.int64).max, np.iinfo(np.int64).max


def dense(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Vectors as the rows of a matrix; missing components are zero."""
    lengths = np.diff(starts)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def tree(labels: np.ndarray, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree over each label of a block.

    A node covers a stretch of the reordered rows and holds their mean, the largest
    distance from it, and the one label they have. It is halved across its widest component
    until ``leaf`` rows are left or all lie in one place. Roots are those that are no child.
    """
    x = dense(flat, starts)
    order = np.lexsort((ids, labels))
    nodes: list[tuple] = []
    centres: list[np.ndarray] = []
    borders = [0, *np.flatnonzero(np.diff(labels[order])) + 1, len(ids)] if len(ids) else [0]
    todo = [(s, e, -1, 0) for s, e in zip(borders[:-1], borders[1:], strict=True)]
    while todo:
        s, e, above, side = todo.pop()
        part = x[order[s:e]].astype(np.float64)
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        if above >= 0:
            nodes[above][2 + side] = len(nodes)
        nodes.append([s, e, -1, -1, labels[order[s]], radius])
        centres.append(centre)
        if e - s > leaf and x.shape[1] and (wide := np.ptp(part, axis=0)).max() > 0:
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(part[:, wide.argmax()], half)]
            todo += [(s, s + half, len(nodes) - 1, 0), (s + half, e, len(nodes) - 1, 1)]
    first, last, left, right, label, radius = (np.array(c) for c in zip(*nodes, strict=True))
    return {"ids": ids[order], "labels": labels[order], "shape": np.array(x.shape), "rows": x[order].ravel(), "from": first, "to": last, "left": left, "right": right, "label": label, "radius": radius.astype(np.float64), "centre": np.concatenate(centres) if x.shape[1] else np.zeros(0)}


def asked_for(keys: np.ndarray, labels: np.ndarray, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    x = dense(flat, starts)
    return {"ids": ids, "keys": keys, "labels": labels, "shape": np.array(x.shape), "rows": x.ravel()}


class Search:
    """Branch and bound over one block's trees for many wanted windows at once.

    An item is an anchor with a window of scores. All items go down together: at a node
    those stay for which the node's bounds, centre product plus and minus radius times
    length, meet the window, and whose upper bound isn't strictly beneath the kth best
    score so far. A tie of the kth is followed, as a smaller id may win it.
    """

    def __init__(self, block: dict, anchors: dict):
        (n, d), (m, e) = block["shape"].tolist(), anchors["shape"].tolist()
        self.d = min(d, e)
        self.x, self.q = block["rows"].reshape(n, d)[:, : self.d], anchors["rows"].reshape(m, e)[:, : self.d]
        if not fits(62, self.x, self.q, self.d):
            raise OverflowError("inner products could pass 63 bits")
        self.exact = np.float64 if fits(52, self.x, self.q, self.d) else np.int64
        self.x, self.q = self.x.astype(self.exact), self.q.astype(self.exact)
        self.block = block
        at = block["centre"].reshape(len(block["from"]), d)[:, : self.d] @ self.q.T.astype(np.float64)
        reach = block["radius"][:, None] * np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        slack = SLACK * (np.abs(at) + reach) + SLACK
        self.upper, self.lower = at + reach + slack, at - reach - slack

    def best(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, same: bool, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, id, score) of the k first rows by score and id of each item, among rows
        of its label if ``same`` else of all others, with scores from low to high; rows
        with the id ``own`` don't count where ``same``."""
        b, items = self.block, len(anchor)
        score, ident = np.full((items, k), NONE), np.full((items, k), MOST)
        child = np.zeros(len(b["from"]), bool)
        for c in (b["left"], b["right"]):
            child[c[c >= 0]] = True
        todo = [(r, np.flatnonzero(((label == b["label"][r]) == same) & (low <= high))) for r in np.flatnonzero(~child)]
        self.visited = self.pruned = 0
        while todo:
            node, active = todo.pop()
            a = anchor[active]
            up = self.upper[node, a]
            active = active[(up >= np.maximum(low[active], score[active, -1])) & (self.lower[node, a] <= high[active])]
            self.pruned += not len(active)
            if not len(active):
                continue
            self.visited += 1
            if b["left"][node] >= 0:
                sides = sorted((b["left"][node], b["right"][node]), key=lambda c: self.upper[c, anchor[active]].sum())
                todo += [(c, active) for c in sides]
                continue
            s, e = b["from"][node], b["to"][node]
            once, at = np.unique(anchor[active], return_inverse=True)
            found = np.rint(self.q[once] @ self.x[s:e].T)[at].astype(np.int64)
            fit = (found >= np.maximum(low[active], score[active, -1])[:, None]) & (found <= high[active][:, None])
            if same:
                fit &= b["ids"][s:e] != own[active][:, None]
            i, row = np.nonzero(fit)
            if not len(i):
                continue
            hit = np.unique(i)
            self._merge(score, ident, active[hit], active[i], found[i, row], b["ids"][s + row], k)
        i, j = np.nonzero(score > NONE)
        return i, ident[i, j], score[i, j]

    @staticmethod
    def _merge(score: np.ndarray, ident: np.ndarray, hit: np.ndarray, item: np.ndarray, new: np.ndarray, ids: np.ndarray, k: int) -> None:
        """The items' best so far and what a leaf adds, ordered again and cut after k."""
        item = np.concatenate([np.repeat(hit, k), item])
        new, ids = np.concatenate([score[hit].ravel(), new]), np.concatenate([ident[hit].ravel(), ids])
        order = np.lexsort((ids, -new, item))
        item, new, ids = item[order], new[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        top = rank < k
        score[item[top], rank[top]], ident[item[top], rank[top]] = new[top], ids[top]


def mine(df: DataFrame, anchors: DataFrame, id_col: str, vector_col: str, label_col: str, positives: int, negatives: int, low_percent: int, high_percent: int, scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors' floor(scale * x); higher ones come first,
    ties by smaller id. An anchor's positives are its first ``positives`` other rows of its
    label. For each, the first ``negatives`` rows of other labels come back whose score
    times 100 lies between the positive's score times the two percentages, so a negative
    positive score has none.

    Rows without id, label or vector, and vectors that hold a null or a component that
    isn't finite, take no part. A missing component of a shorter vector is zero; sums that
    could pass 63 bits raise OverflowError. Rows with the anchor's id aren't its positives;
    a repeated row counts as often as it is there, as positive and as negative, but a
    repeated anchor is one anchor; anchors that share an id and differ in vector or label
    are mined apart. Other columns are left out; an empty table gives an empty result.

    Trees stand over blocks of a task's own rows, are written to the shared folder once,
    and are searched twice: for the positives of all anchors, then for the windows that
    these give.
    """
    scratch = Scratch(df.sparkSession, "negatives")
    label = F.col(label_col).cast("long")
    part = lambda d: taking_part(d.where(label.isNotNull()), id_col, vector_col, label=label)
    blocks = scratch.keep(in_blocks(part(df).select("label", "id", "vector"), scale, block_rows, tree, TREE), "trees")
    count = blocks.count()
    once = scratch.keep(part(anchors).distinct().select(F.xxhash64("label", "vector").alias("key"), "label", "id", "vector"), "anchors")
    asked = in_blocks(once, scale, QUERY_ROWS, asked_for, ASKED)

    def nearest(block: dict, q: dict) -> dict[str, np.ndarray]:
        every = np.arange(len(q["ids"]))
        i, ids, score = Search(block, q).best(every, np.full(len(every), NONE), np.full(len(every), MOST), q["labels"], True, q["ids"], positives)
        return {"anchor_id": q["ids"][i], "key": q["keys"][i], "positive_id": ids, "score": score}

    found = meet(blocks, count, asked, nearest, ["anchor_id", "key", "positive_id", "score"])
    found = scratch.keep(first_of(found, ["anchor_id", "key"], positives, "score", "positive_id"), "positives")

    # the windows: an anchor's row once for each positive, which shares its vector in a block
    pairs = found.select(F.col("anchor_id").alias("id"), "key", F.col("rank").cast("long").alias("nth"), "positive_id", F.col("score").alias("positive_score")).join(once, ["id", "key"])
    windows = in_blocks(pairs.select("key", "label", "id", "nth", "positive_id", "positive_score", "vector"), scale, QUERY_ROWS, windows_of, [*ASKED, *WINDOW])

    def between(block: dict, q: dict) -> dict[str, np.ndarray]:
        p = q["positive_score"].astype(np.int64)
        low, high = times_percent(p, low_percent, up=True), times_percent(p, high_percent, up=False)
        i, ids, score = Search(block, q).best(q["anchor"], low, high, q["labels"][q["anchor"]], False, q["ids"][q["anchor"]], negatives)
        a = q["anchor"][i]
        return {"anchor_id": q["ids"][a], "key": q["keys"][a], "nth": q["nth"][i], "positive_id": q["positive_id"][i], "negative_id": ids, "positive_score": p[i], "negative_score": score}

    hits = meet(blocks, count, windows, between, ["anchor_id", "key", "nth", "positive_id", "negative_id", "positive_score", "negative_score"])
    return first_of(hits, ["anchor_id", "key", "nth"], negatives, "negative_score", "negative_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


WINDOW = ["anchor", "nth", "positive_id", "positive_score"]


def windows_of(keys: np.ndarray, labels: np.ndarray, ids: np.ndarray, nth: np.ndarray, positive: np.ndarray, score: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Windows and, once each, the anchors they belong to."""
    _, first, anchor = np.unique(np.stack([ids, keys], axis=1), axis=0, return_index=True, return_inverse=True)
    x = dense(flat, starts)[first]
    return {"ids": ids[first], "keys": keys[first], "labels": labels[first], "shape": np.array(x.shape), "rows": x.ravel(), "anchor": anchor.ravel(), "nth": nth, "positive_id": positive, "positive_score": score}


def times_percent(x: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """x * percent / 100, rounded up or down, without overflow."""
    whole, rest = x // 100, x % 100
    return whole * percent + (-((-rest * percent) // 100) if up else (rest * percent) // 100)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 5, 3, 50, 95)


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(range(1, 1 + least(len(a.v), len(c.v))), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.label <> c.label OR a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM pairs WHERE same QUALIFY nth <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, nth ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
