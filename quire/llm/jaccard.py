"""Operator 7, n-gram Jaccard join: a token-group matrix bounds what is compared.

Exact: every pair of different sets at or above the threshold is linked, or joined
through other links, whatever the groups are. Only work depends on them.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one class, found by a
   128-bit hash of the set; from here on there is a row a class.
2. Shingles are ordered from rare to common. A set needs only its first
   n - ceil(t * n) + m in that order: two sets at similarity t share m of them, for the
   lesser m of both. m grows with n, so that a shared passage is no candidate.
3. Classes that look alike (equal minhash bands) form groups of bounded size, with a
   few guests from groups of the same band. Links inside groups join them to families.
4. Families of several groups are taken out of these. The matrix of leading shingles
   and units (such families and the groups that are left) gives the pairs of units of
   fitting sizes that share as many as the least m in them, and within these the pairs
   of groups; groups of one such family are never paired, however many it has.
   For each such pair, each set's overlap with the other group's union of shingles
   bounds its overlap with any member; only where the bound reaches ceil(t * n) are the
   members compared. A pair of groups returns a forest of links, not all of them.
5. Components over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, in_batches, mix, shingle_hashes, table
from quire.llm.components import components

#: Members of a group, and shingles of a group, at most (a single larger set is a group of its own).
GROUP, WEIGHT = 64, 200_000
#: Hash buckets in which a task counts its shingles, and how many of them are known to all tasks at most.
BUCKETS, NAMED = 1 << 25, 1 << 21
#: Parts of a large family whose groups hold the same guest.
FAN = 8
#: A set must share 2 + n // SHARED of its leading shingles.
SHARED = 40
#: Bits that say which documents' sets are wanted; a false one costs work only.
BITS = 1 << 22
#: Minhash bands, and the values that one is made of.
BANDS, VALUES = 4, 3


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, 256):
        for t in batch.column(column).slice(at, 256).to_pylist():
            yield shingle_hashes((t or "").encode("utf-8", "surrogatepass"), k)


def _print(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of shingles that many documents have, in order, and about how many do.

    Only an order is made of it, the same for all sets, so counts may be rough: a task
    names the buckets that it met twice or more (more often if its input is so large
    that chance fills them), and of their sums over all tasks the NAMED largest are used,
    at any size of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(BUCKETS, np.uint8), 0
        for b in batches:
            for s in _sets(b, 0, k):
                at = (s & np.uint64(BUCKETS - 1)).astype(np.int64)
                total[at] += total[at] < 255
                met += len(s)
        for i in range(0, BUCKETS, 1 << 20):
            part = i + np.flatnonzero(total[i : i + (1 << 20)] >= 2 + int(6 * met / BUCKETS))
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["bucket", "n"])

    counted = docs.select("text").transform(in_batches, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n >= 6")
    got = counted.orderBy(F.desc("n"), "bucket").limit(NAMED).toArrow().sort_by("bucket")
    return got["bucket"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int32)


def least_size(percent: int) -> int:
    """Below this size a set is similar to none but an equal one."""
    return next(n for n in range(1, 1 << 20) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62


def shared(n: int) -> int:
    """How many leading shingles a set of n must share with a similar one."""
    return 2 + n // SHARED


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, print, bands, lead): lead holds the leading shingles, for sets that can be similar to others."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))  # NAMED pairs at most
    least = least_size(percent)
    seeds = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)) for i in range(VALUES * BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = common.value
        names, times = np.append(names, 1 << 62), np.append(times, 0)
        for b in batches:
            n, prints, bands, lead = [], [], [], []
            for s in _sets(b, 1, k):
                n.append(len(s))
                prints.append(_print(s))
                if len(s) < least:
                    bands.append([])
                    lead.append([])
                    continue
                low = np.array([mix(s ^ x).min() for x in seeds], np.uint64)
                band = np.arange(BANDS, dtype=np.uint64)
                for j in range(VALUES):
                    band = mix(band + low[j::VALUES])
                bands.append(band.view(np.int64))
                # one more than asked for: two of them may be equal by the halves of their hashes
                take = min(len(s), len(s) - -(-percent * len(s) // 100) + shared(len(s)) + 1)
                bucket = (s & np.uint64(BUCKETS - 1)).astype(np.int64)
                at = np.searchsorted(names, bucket)
                often = np.where(names[at] == bucket, times[at], 0)
                # for candidates half a hash does
                lead.append((s[np.lexsort((s, often))[:take]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(lead, pa.list_(pa.int32()))], names=["doc_id", "n", "print", "bands", "lead"])

    return docs.select("doc_id", "text").transform(in_batches, run, "doc_id long, n long, print binary, bands array<long>, lead array<int>")


class _Forest:
    """Union-find over a few members; ``edges`` are the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


class _Group:
    """Members' sets with the group's shingles in order, each with the member that has it."""

    def __init__(self, members: list[dict]):
        self.ids = [m["cid"] for m in members]
        self.sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
        self.n = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.n)[order]

    def overlaps(self, s: np.ndarray, percent: int) -> np.ndarray | None:
        """Each member's shingles in common with s; None if the union's bound rules all out."""
        lo, hi = np.searchsorted(self.flat, s), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        if 100 * np.count_nonzero(n) < percent * len(s):
            return None
        n, lo = n[n > 0], lo[n > 0]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))


def _compare(a: _Group, b: _Group, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the groups' members (or inside one group)."""
    forest = _Forest()
    for i, s in enumerate(a.sets):
        got = b.overlaps(s, percent)
        if got is not None:
            for j in np.flatnonzero(100 * got >= percent * (len(s) + b.n - got)):
                if a.ids[i] != b.ids[j]:
                    forest.join(a.ids[i], b.ids[int(j)])
    return forest.edges


def _links(groups: list[str], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                gs = [_Group(b.column(c)[at].as_py()) for c in range(len(groups))]
                edges = _compare(gs[0], gs[-1], percent)
                if edges:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

    return run


def _load(docs: DataFrame, members: DataFrame, classes: DataFrame, k: int, s: Scratch, name: str) -> DataFrame:
    """(gid, members) with the members' whole sets, which are made anew from the texts of those that are asked for."""
    wanted = s.keep(members.join(classes, "cid").select(F.col("cid").alias("doc_id"), "gid", F.col("print").alias("want")), f"wanted{name}")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int")
    bits = np.zeros(BITS, bool)
    bits[wanted.select(bit.alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True  # BITS at most
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bits.value
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool), pa.bool_()))
            sets = list(_sets(b, 1, k))
            yield pa.record_batch([b.column(0), pa.array([_print(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "want", "shingles"])

    sets = docs.where("doc_id IS NOT NULL").select("doc_id", "text", bit.alias("bit")).transform(in_batches, load, "doc_id long, want binary, shingles binary")
    sets = sets.join(wanted, ["doc_id", "want"]).select(F.col("doc_id").alias("cid"), "gid", "shingles")
    return s.keep(sets.groupBy("gid").agg(F.collect_list(F.struct("cid", "shingles")).alias("members")), f"groups{name}")  # bounded by GROUP and WEIGHT


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A text's set holds its distinct k-word shingles, with A-Z lower-cased; with fewer
    words the whole sequence is the one shingle; null, empty and wordless texts have an
    empty set that is linked with nothing. Sets are linked if 100 * shared >= percent *
    union. ``component_id`` is the least id reachable, itself included; it is null for a
    null id unless its set is another row's, too. Rows that share an id are one document in the components.
    An empty table gives an empty result.

    What is shuffled for each set: its leading shingles, and the whole set only of
    members of groups that share enough with another; texts never are. Groups are bounded, so one family of
    copies, however large, is many small groups; a class of equal texts is one row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = Scratch(spark, "jaccard")
    whole = s.keep(_profiles(docs, k, percent), "whole")
    profiles = s.keep(whole.select("doc_id", "n", "print"), "profiles")

    classes = whole.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("lead").alias("lead"))
    wide = s.keep(classes, "wide")
    classes = s.keep(wide.select("print", "cid", "n"), "classes")
    s.drop("whole")
    able = wide.where(F.size("lead") > 0)

    bands = able.select("cid", "n", F.explode("bands").alias("band"))
    alike = bands.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1")
    best = bands.join(alike, "band").groupBy("cid").agg(F.max(F.struct("c", "w", "band")).alias("b"))
    parts = F.greatest(F.ceil(F.col("b.c") / GROUP), F.ceil(F.col("b.w") / WEIGHT))
    grouped = best.select("cid", "b.band", F.pmod(F.xxhash64("cid"), parts).alias("part"))
    # a group is named by its least member, a class that is like no other by itself
    named = grouped.groupBy("band", "part").agg(F.min("cid").alias("gid"))
    own = grouped.join(named, ["band", "part"]).where("cid <> gid").select("cid", "gid")
    # a family that fills many groups: the least members of two lower parts sit in each
    lower = named.where("part > 0").select("band", F.explode(F.array_distinct(F.array(F.expr(f"part DIV {FAN}"), F.col("part") - 1))).alias("part"), F.col("gid").alias("of"))
    guests = lower.join(named, ["band", "part"]).select(F.col("gid").alias("cid"), F.col("of").alias("gid"))
    own = s.keep(own, "own")
    first = own.unionByName(guests)
    first = first.unionByName(first.select(F.col("gid").alias("cid"), "gid")).distinct()
    groups = _load(docs, first, classes, k, s, "1")
    inside = groups.select("members").transform(in_batches, _links(["members"], percent), "a long, b long")
    families = components(s.keep(inside, "inside"), s, "families")
    s.drop("groups1", "wanted1")

    # families of several groups are taken out of them; groups of one family need no comparison
    own = own.unionByName(own.select(F.col("gid").alias("cid"), "gid").distinct()).join(families, F.col("cid") == F.col("node"), "left").select("cid", "gid", F.coalesce("root", "cid").alias("comp"))
    own = s.keep(own, "placed")
    wide_ones = own.select("gid", "comp").distinct().groupBy("comp").count().where("count > 1").select("comp", F.col("comp").alias("family"))
    own = s.keep(own.join(wide_ones, "comp", "left").select("cid", "gid", "family"), "families")
    split = own.groupBy("gid", "family").agg(F.min("cid").alias("part"))
    own = own.alias("o").join(split.alias("p"), F.expr("o.gid = p.gid AND o.family <=> p.family")).select("cid", F.col("part").alias("gid"), F.coalesce("o.family", "part").alias("comp"))
    own = s.keep(own.where("cid <> gid OR cid <> comp"), "split")
    members = able.join(own, "cid", "left").select(F.explode("lead").alias("shingle"), F.coalesce("gid", "cid").alias("gid"), F.coalesce("comp", "cid").alias("comp"), "n")
    # sets of too different sizes are never similar
    sizes = [F.min("n").alias("lo"), F.max("n").alias("hi")]
    met = F.expr(f"x.shingle = y.shingle AND x.comp < y.comp AND 100 * x.hi >= {percent} * y.lo AND 100 * y.hi >= {percent} * x.lo")
    least = F.expr(f"2 + least(min(x.lo), min(y.lo)) DIV {SHARED}")
    of_family = members.repartition("shingle").groupBy("shingle", "comp").agg(*sizes)  # dealt once, for both sides of the join
    both = of_family.alias("x").join(of_family.alias("y"), met).groupBy(F.col("x.comp").alias("c1"), F.col("y.comp").alias("c2"))
    both = s.keep(both.agg(F.count("*").alias("c"), least.alias("m")).where("c >= m").select("c1", "c2"), "both")
    # a family with a group that doesn't bear its name has several
    several = s.keep(own.where("gid <> comp").select("comp").distinct(), "several")
    marked = both.join(several.select(F.col("comp").alias("c1"), F.lit(True).alias("s1")), "c1", "left").join(several.select(F.col("comp").alias("c2"), F.lit(True).alias("s2")), "c2", "left")
    plain = marked.where("s1 IS NULL AND s2 IS NULL").select(F.col("c1").alias("g1"), F.col("c2").alias("g2"))
    large = s.keep(marked.where("s1 OR s2").select("c1", "c2"), "large")
    in_large = members.join(large.select(F.explode(F.array("c1", "c2")).alias("comp")).distinct(), "comp", "left_semi").groupBy("shingle", "comp", "gid").agg(*sizes)
    at = in_large.groupBy("shingle", "comp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = at.alias("x").join(at.alias("y"), met).select("x.shingle", F.col("x.comp").alias("c1"), F.col("y.comp").alias("c2")).join(large, ["c1", "c2"])
    for i in ("1", "2"):
        at = at.join(in_large.select("shingle", F.col("comp").alias(f"c{i}"), F.col("gid").alias(f"g{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")), ["shingle", f"c{i}"])
    at = at.where(f"100 * hi1 >= {percent} * lo2 AND 100 * hi2 >= {percent} * lo1")
    apart = at.groupBy("g1", "g2").agg(F.count("*").alias("c"), F.expr(f"2 + least(min(lo1), min(lo2)) DIV {SHARED}").alias("m")).where("c >= m").select("g1", "g2")
    pairs = s.keep(plain.unionByName(apart), "pairs")
    s.drop("wide")
    gids = pairs.select(F.explode(F.array("g1", "g2")).alias("gid")).distinct()
    second = gids.select(F.col("gid").alias("cid"), "gid").unionByName(own.where("cid <> gid").join(gids, "gid", "left_semi").select("cid", "gid"))
    groups = _load(docs, second, classes, k, s, "2")
    left, right = (groups.select(F.col("gid").alias(g), F.col("members").alias(m)) for g, m in (("g1", "m1"), ("g2", "m2")))
    across = pairs.join(left, "g1").join(right, "g2").select("m1", "m2").transform(in_batches, _links(["m1", "m2"], percent), "a long, b long")
    links = s.keep(across.unionByName(families.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
    s.drop("wanted2", "groups2", "pairs")
    roots = components(links, s)

    of_class = classes.join(roots, F.col("cid") == F.col("node"), "left").select("print", F.coalesce("root", "cid").alias("component_id"))
    out = profiles.select("doc_id", "n", "print").join(of_class, "print", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the least id of each.

    Rows without an id or without words are kept. Rows that share an id are one document:
    they go or stay together. Other columns pass through, whatever their names are.
    """
    got = similar(docs, id_col, text_col, k, percent)
    gone = got.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = Scratch(docs.sparkSession, "copies").keep(gone, "gone")  # as a file its size is known when the join is planned
    # most rows that stay are told by a bit of their id; only the others are joined, texts and all
    bits = np.zeros(BITS, bool)
    bits[gone.select(F.pmod(F.xxhash64("gone"), F.lit(BITS)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True  # BITS at most
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def maybe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packed = bits.value
        for b in batches:
            at = b.fill_null(0).to_numpy()  # rows without an id are kept whatever this says
            yield pa.array((packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    key = F.col(f"`{id_col}`").cast("long")
    # the whole row is one column from here on, so no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), (key.isNotNull() & maybe(F.pmod(F.xxhash64(key), F.lit(BITS)).cast("int"))).alias("maybe"))
    sure, rest = rows.where("NOT maybe"), rows.where("maybe")
    return sure.select("row.*").unionByName(rest.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), k=3, percent=90)


_WORDS = r"'[^\x20\x09-\x0D]+'"
#: The join in DuckDB's SQL: sets by their shingles' texts, all pairs that share one, components by recursion.
OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents
),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g FROM w),
h AS (SELECT doc_id, md5(array_to_string(g, ' ')) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM h x JOIN h y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
