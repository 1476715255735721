"""Operator 12, exact top-k search: postings scattered term by term into dense score arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, table
from quire.llm.vectors import BLOCK_ROWS, QUERY_ROWS, first_of, fits, in_blocks, meet, taking_part

#: Queries whose scores a block keeps at a time: 32 arrays of a block's rows stay in a core's cache.
AT_A_TIME = 32
LISTS = ["ids", "terms", "starts", "rows", "weights"]


def postings(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """A block's inverted index: for each term (component number) that a row holds, the rows that do and their weights.

    Rows are numbered by ascending id; zeros are in no list. ``starts`` has an end, too.
    """
    order = np.argsort(ids, kind="stable")
    row = np.empty(len(ids), np.int64)
    row[order] = np.arange(len(ids))
    lengths = np.diff(starts)
    term = np.arange(len(flat)) - np.repeat(starts[:-1], lengths)
    rows = np.repeat(row, lengths)
    held = flat != 0
    term, rows, weights = term[held], rows[held], flat[held]
    by = np.lexsort((rows, term))
    terms, first = np.unique(term[by], return_index=True)
    return {"ids": ids[order], "terms": terms, "starts": np.append(first, len(by)), "rows": rows[by], "weights": weights[by]}


def keyed(keys: np.ndarray, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Postings of queries, numbered as ``ids`` orders them, with their keys in that order."""
    return postings(ids, flat, starts) | {"keys": keys[np.argsort(ids, kind="stable")]}


def scores(block: dict, queries: dict, low: int, high: int, dtype: type) -> np.ndarray:
    """The dense scores of queries low to high (a row each) with a block's rows.

    For every term that one of these queries holds, all its postings are scattered into
    the arrays of the queries that hold it, weighted by theirs. No posting is left out.
    """
    out = np.zeros((len(block["ids"]), high - low), dtype)
    shared, a, b = np.intersect1d(block["terms"], queries["terms"], assume_unique=True, return_indices=True)
    for i, j in zip(a, b, strict=True):
        s, e = queries["starts"][j : j + 2]
        s, e = s + np.searchsorted(queries["rows"][s:e], (low, high))
        if s == e:
            continue
        at, to = block["starts"][i : i + 2]
        rows, add = block["rows"][at:to], np.multiply.outer(block["weights"][at:to].astype(dtype), queries["weights"][s:e].astype(dtype))
        if e - s < high - low:
            out[np.ix_(rows, queries["rows"][s:e] - low)] += add
        elif to - at < len(out):
            out[rows] += add
        else:
            out += add
    return np.ascontiguousarray(out.T)


def best(found: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k highest scores among the block's other rows, ties to smaller ids.

    A partition finds the kth score; all above it go through, then those equal to it in
    the order of rows, which is that of ids. Rows with the query's own id don't count.
    """
    other = ids[None, :] != own[:, None]
    least = found.min() - 1
    found = np.where(other, found, least)
    n = found.shape[1]
    if n > k:
        kth = np.partition(found, n - k, axis=1)[:, n - k, None]
        above = found > kth
        level = (found == kth) & other
        above |= level & (np.cumsum(level, axis=1) <= k - np.count_nonzero(above, axis=1)[:, None])
        return np.nonzero(above & other)
    return np.nonzero(other)


def search(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of ``df`` with the highest inner products, ties to smaller ids.

    Components x count as floor(scale * x); products are exact, and sums that could pass 63
    bits raise OverflowError. A missing component of a shorter vector is zero. Rows without
    an id, and vectors that are null or hold a null or a component that isn't finite, take
    no part, as queries nor as candidates; empty vectors do. Rows with the query's own id
    aren't its candidates. A candidate row that is repeated comes up as often as it is
    there; a query row that is repeated is one query, and queries that share an id but not
    the vector are ranked apart. Fewer than k candidates: all. Other columns are left out;
    an empty table, or none that takes part, gives an empty result.

    All pairs of a query and a row are scored; candidate blocks are indexed once, written
    to the shared folder, and met by blocks of queries.
    """
    scratch = Scratch(df.sparkSession, "topk")
    blocks = scratch.keep(in_blocks(taking_part(df, id_col, vector_col), scale, block_rows, postings, LISTS), "postings")
    asked = taking_part(queries, id_col, vector_col).distinct()
    # as queries, rows are numbered by id, and those that share one are told apart by the key
    asked = in_blocks(asked.select(F.xxhash64("vector").alias("key"), "id", "vector"), scale, QUERY_ROWS, keyed, [*LISTS, "keys"])

    def run(block: dict, wanted: dict) -> dict[str, np.ndarray]:
        terms = min(len(block["terms"]), len(wanted["terms"]))
        if not fits(62, block["weights"], wanted["weights"], terms):
            raise OverflowError("inner products could pass 63 bits")
        dtype = np.int32 if fits(30, block["weights"], wanted["weights"], terms) else np.int64
        out: list[tuple] = []
        for low in range(0, len(wanted["ids"]), AT_A_TIME):
            high = min(low + AT_A_TIME, len(wanted["ids"]))
            found, own = scores(block, wanted, low, high, dtype), wanted["ids"][low:high]
            q, row = best(found, block["ids"], own, k)
            out.append((own[q], wanted["keys"][low:high][q], block["ids"][row], found[q, row]))
        return dict(zip(("query_id", "key", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    hits = meet(blocks, blocks.count(), asked, run, ["query_id", "key", "vec_id", "score"])
    return first_of(hits, ["query_id", "key"], k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
QUALIFY rank <= 5
"""
