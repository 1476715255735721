"""Operator 1, URL filters: rules first, then a character language-model ratio."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Scratch, table

#: The contract's rules (fixed values): verdict and host + path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Characters of context at most, and URLs of each verdict that the models are fitted on: all.
ORDER, SAMPLE = 5, None
#: Every so many-th decided URL is held out for calibration, the others are what the models are fitted on.
HOLD = 4
#: Characters of a block of URLs that are scored together, and rows of a URL from which on it is looked up.
BLOCK, MANY = 200_000, 10_000


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` (the longest that fits, else null) and ``ruling`` (its verdict, else null)."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(slash + p))
        rule = rule.when(fits, r) if rule is not None else F.when(fits, r)
        verdict = verdict.when(fits, v) if verdict is not None else F.when(fits, v)
    return df.withColumns({"rule": rule, "ruling": verdict})


class Markov:
    """A character model that mixes all context lengths up to ``order``.

    P(c | s) = (n(s, c) + d(s) * P(c | s without its first)) / (n(s) + d(s)) with n counts
    and d(s) the distinct characters seen after s (Witten-Bell); below the empty context
    every byte value is as likely. Contexts never seen add nothing, so the order varies.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.after = order, {}

    def fit(self, texts: list[str]) -> Markov:
        for t in texts:
            t = "\x02" + t + "\x03"
            for i in range(1, len(t)):
                for k in range(min(self.order, i) + 1):
                    d = self.after.setdefault(t[i - k : i], {})
                    d[t[i]] = d.get(t[i], 0) + 1
        self.sums = {s: (sum(d.values()), len(d)) for s, d in self.after.items()}
        return self

    def log(self, text: str) -> float:
        """The log-probability of a text."""
        t, total = "\x02" + text + "\x03", 0.0
        for i in range(1, len(t)):
            p = 1 / 256
            for k in range(min(self.order, i) + 1):
                s = t[i - k : i]
                d = self.after.get(s)
                if d is None:
                    break
                n, kinds = self.sums[s]
                p = (d.get(t[i], 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


class Ratio:
    """Two models and the least length-normalised log-likelihood difference that is allowed, on lists; ``cut`` and ``judge`` do the same on tables."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        self.usable = bool(accepted and rejected)
        if self.usable:
            parts = [([x for i, x in enumerate(u) if i % HOLD], [x for i, x in enumerate(u) if i % HOLD == 0]) for u in (accepted, rejected)]
            self.good, self.bad = (Markov().fit(fit) for fit, _ in parts)
            self.held = [[self.score(x) for x in hold] for _, hold in parts]
            self.threshold, self.accuracy = self._calibrate(*self.held)

    @staticmethod
    def _calibrate(good: list[float], bad: list[float]) -> tuple[float, float]:
        """The cut with the highest mean of both held-out classes' accuracies (the lowest such cut)."""
        best = (-1.0, 0.0)
        marks = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
        kept, caught = len(good), 0
        for i in range(len(marks) + 1):
            if i == len(marks) or i == 0 or marks[i][0] != marks[i - 1][0]:
                acc = (kept / len(good) + caught / len(bad)) / 2
                cut = marks[0][0] - 1 if i == 0 else marks[-1][0] + 1 if i == len(marks) else (marks[i - 1][0] + marks[i][0]) / 2
                if acc > best[0]:
                    best = (acc, cut)
            if i < len(marks):
                kept -= marks[i][1]
                caught += 1 - marks[i][1]
        return best[1], best[0]

    def score(self, text: str) -> float:
        return score(self.good, self.bad, text)

    def allows(self, text: str) -> bool:
        return not self.usable or self.score(text) >= self.threshold


def score(good: Markov, bad: Markov, text: str) -> float:
    return (good.log(text) - bad.log(text)) / (len(text) + 1)


def ordered(urls: DataFrame) -> DataFrame:
    """``urls`` (u, ruling) with ``i``: the place from 0 among those of a ruling, by a hash of the URL and itself.

    Ranks are taken inside ranges of the hash, which are as many at any size, so no task orders all of a ruling.
    """
    urls = urls.withColumn("x", F.xxhash64("u")).withColumn("range", F.shiftright("x", 52))
    sizes = urls.groupBy("ruling", "range").count()
    before = F.sum("count").over(Window.partitionBy("ruling").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    starts = sizes.select("ruling", "range", before.alias("before"))  # two rulings of 4,096 ranges at most
    place = F.row_number().over(Window.partitionBy("ruling", "range").orderBy("x", "u"))
    return urls.withColumn("place", place).join(F.broadcast(starts), ["ruling", "range"]).select("u", "ruling", (F.col("before") + F.col("place") - 1).alias("i"))


def _grams(*keys: str) -> list[Column]:
    """With ``keys``, a row for each character of ``u`` and its end: it and up to ``ORDER`` before it, as ``g``."""
    t = F.concat(F.lit("\x02"), "u", F.lit("\x03"))
    first = lambda p: F.greatest(p - ORDER, F.lit(1))
    return [*map(F.col, keys), F.explode(F.transform(F.sequence(F.lit(2), F.length(t)), lambda p: F.substr(t, first(p), p - first(p) + 1))).alias("g")]


def counts(fitted: DataFrame) -> DataFrame:
    """(s, n_allow, c_allow, d_allow, n_block, ..) of the models of all URLs (u, ruling): how often a string occurs, is followed, and by how many characters."""
    whole = fitted.select(*_grams("ruling")).groupBy("ruling", "g").count()
    n = F.length("g")
    ends = F.explode(F.transform(F.sequence(F.lit(1), n), lambda p: F.substr(F.col("g"), p)))
    parts = whole.select("ruling", "count", ends.alias("g")).groupBy("ruling", "g").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    seen = F.struct(F.col("g").alias("s"), F.col("n").alias("n"), zero.alias("c"), zero.alias("d"))
    context = F.struct(F.substr("g", F.lit(1), n - 1).alias("s"), zero.alias("n"), F.col("n").alias("c"), F.lit(1).cast("long").alias("d"))
    rows = parts.select("ruling", F.inline(F.array(seen, context)))
    return rows.groupBy("s").agg(*[F.sum(F.when(F.col("ruling") == v, F.col(k)).otherwise(0)).alias(f"{k}_{v}") for v in ("allow", "block") for k in "ncd"])


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (u and whatever else) with ``score``.

    The URLs go in blocks of about ``BLOCK`` characters, and each block gets the counts of
    the strings that it holds, so no task and no driver takes a whole model.
    """
    parts = -(-(urls.agg(F.sum(F.length("u"))).first()[0] or 1) // BLOCK)
    urls = urls.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "u"), F.lit(parts)))
    whole = urls.select(*_grams("block")).distinct()
    n = F.length("g")
    held = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda p: F.array(F.substr(F.col("g"), p), F.substr(F.col("g"), p, n - p))))
    held = whole.select(F.col("block").alias("of"), F.explode(held).alias("s")).distinct().join(model, "s")
    out = T.StructType([*urls.drop("block").schema, T.StructField("score", T.DoubleType())])

    def run(block: pa.Table, counted: pa.Table) -> pa.Table:
        models = []
        s = counted.column("s").to_pylist()
        for v in ("allow", "block"):
            m = Markov()
            m.sums = {}
            for k, times, total, kinds in zip(s, *(counted.column(f"{c}_{v}").to_pylist() for c in "ncd"), strict=True):
                if times:
                    m.after.setdefault(k[:-1], {})[k[-1]] = times
                if total:
                    m.after.setdefault(k, {})
                    m.sums[k] = total, kinds
            models.append(m)
        block = block.drop_columns(["block"])
        return block.append_column("score", pa.array([score(*models, u) for u in block.column("u").to_pylist()], pa.float64()))

    return urls.groupBy("block").cogroup(held.groupBy("of")).applyInArrow(run, out)


def cut(held: DataFrame) -> float | None:
    """``Ratio``'s threshold from the scores of all held-out URLs (ruling, score); None without URLs of both verdicts.

    Scores are counted in levels of 1/4096, of which there are as many at any size; the order inside a level is its own window's.
    """
    each = held.groupBy("score").agg(*[F.count_if(F.col("ruling") == v).alias(v) for v in ("allow", "block")])
    each = each.withColumn("level", F.floor(F.greatest(F.least(F.col("score"), F.lit(32.0)), F.lit(-32.0)) * 4096))
    levels = each.groupBy("level").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.max("score").alias("top"))
    w = Window.orderBy("level")  # at most 2**18 levels
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ever = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = levels.select("level", (F.sum("a").over(upto) - F.col("a")).alias("a0"), (F.sum("b").over(upto) - F.col("b")).alias("b0"), F.lag("top").over(w).alias("under"), F.sum("a").over(ever).alias("a"), F.sum("b").over(ever).alias("b"))
    w = Window.partitionBy("level").orderBy("score")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"below": F.sum("allow").over(upto) - F.col("allow"), "caught": F.sum("block").over(upto) - F.col("block"), "last": F.lag("score").over(w)}).join(F.broadcast(levels), "level")
    last = F.coalesce("last", "under")
    cuts = each.where("a > 0 AND b > 0").select(
        (((F.col("a") - F.col("a0") - F.col("below")) / F.col("a") + (F.col("b0") + F.col("caught")) / F.col("b")) / 2).alias("accuracy"),
        F.coalesce((last + F.col("score")) / 2, F.col("score") - 1).alias("cut"),
    )
    best = cuts.orderBy(F.desc("accuracy"), "cut").first()
    return best.cut if best else None


def judge(df: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """The rows of ``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule decides where one fits; elsewhere the model ratio of host + path does, also for
    URLs without a host (null, empty, no ``://``), whose host + path is empty. The models
    are fitted and their cut is calibrated on all distinct URLs that rules decide; without
    URLs of both verdicts the method allows everything. Columns of ``df`` with those names
    are replaced; repeated rows are judged alike; an empty table stays empty.
    """
    made = ("host", "path", "rule", "ruling", "verdict")
    url = F.col(f"`{url_col}`").cast("string")
    carried = [F.col(f"`{c}`") for c in df.columns if c not in made]
    rows = ruled(df.select(*carried, host(url).alias("host"), path(url).alias("path")), rules)
    kept = Scratch(df.sparkSession, "urls")
    # the path begins where the host ends, so a URL's ruling is that of its host + path
    urls = kept.keep(rows.groupBy(F.concat("host", "path").alias("u"), "ruling").agg(F.count("*").alias("rows")), "urls")
    decided = kept.keep(ordered(urls.where("ruling IS NOT NULL").select("u", "ruling")), "decided")
    model = counts(decided.where(f"i % {HOLD} <> 0"))
    asked = decided.where(f"i % {HOLD} = 0").selectExpr("u", "ruling", "0L AS rows").unionByName(urls.where("ruling IS NULL"))
    got = kept.keep(scored(asked, model), "scores")
    least = cut(got.where("ruling IS NOT NULL"))
    free = got.where("ruling IS NULL").select(F.col("u").alias("_u"), "rows", F.when(F.lit(least is None) | (F.col("score") >= F.lit(least)), "allow").otherwise("block").alias("_v"))
    # the most repeated URLs, which are few, are looked up; no task gets all rows of one
    many = free.where(f"rows > {MANY}").select(F.col("_u").alias("_m"), F.col("_v").alias("_w"))
    rows = rows.withColumn("_k", F.concat("host", "path")).join(F.broadcast(many), F.col("_k") == F.col("_m"), "left")
    rows = rows.withColumn("_k", F.when(F.col("ruling").isNull() & F.col("_w").isNull(), F.col("_k")).otherwise(F.concat(F.lit("\x00"), F.monotonically_increasing_id())))
    rows = rows.join(free.where(f"rows <= {MANY}").drop("rows"), F.col("_k") == F.col("_u"), "left")
    return rows.withColumn("verdict", F.coalesce("ruling", "_w", "_v")).drop("ruling", "_k", "_m", "_w", "_u", "_v")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "host", "path", "rule", "verdict")
