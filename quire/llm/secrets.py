"""Operator 9, secret scans: a trigram inverted index in front of regular expressions.

Everything that touches rows is a DataFrame expression. Python only reads the rules,
at plan time, to derive what each of them must contain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, table

try:  # the parser behind ``re``; its public name went in Python 3.13
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, and how long the match (or a group) must be.

    A pattern whose leading run may begin at each of many characters is tried at each,
    and every try goes on to the run's end. Two things make one try of them, with the same
    matches: ``behind``, what can't stand before a match, as the run would begin there;
    or ``run``, what a try that fails passes over, as no later start in it can do better.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False
    behind: str = ""
    run: str = ""


#: The three base rules of the contract, in its order, then well-known public key formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, run=r"eyJ[A-Za-z0-9_-]++"),
    Rule("login", r"[a-z]+://[A-Za-z0-9_.-]+:[^\x00-\x20@/:]+@", 10, behind="(?<![a-z])"),
)

#: Alternatives that a literal run may fan out to before it is cut.
FAN_OUT = 64


def mandatory(pattern: str) -> list[frozenset[str]]:
    """What every match must contain, lower-cased: an AND of ORs of literal strings.

    The parse tree is walked with the set of strings that the run of nodes so far
    can spell. A node that can spell anything closes the run; a run whose strings
    all have three characters or more is a clause. No clause: no trigram is mandatory.
    """
    clauses: list[frozenset[str]] = []

    def close(run: set[str]) -> set[str]:
        if run and min(map(len, run)) >= 3:
            clauses.append(frozenset(run))
        return {""}

    def spelled(nodes) -> set[str] | None:
        """All strings that the nodes can spell, or None if they are too many."""
        run = {""}
        for op, arg in nodes:
            part = one(op, arg)
            if part is None or len(run) * len(part) > FAN_OUT:
                return None
            run = {a + b for a, b in product(run, part)}
        return run

    def one(op, arg) -> set[str] | None:
        if op is _c.LITERAL:
            return {chr(arg).lower()}
        if op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is _c.BRANCH:
            parts = [spelled(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        if op is _c.SUBPATTERN:
            return spelled(arg[-1])
        if op is _c.MAX_REPEAT and arg[1] <= 3:
            x = spelled(arg[2])
            return None if x is None or len(x) ** arg[1] > FAN_OUT else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(x, repeat=n)}
        return None

    def walk(nodes, run: set[str]) -> set[str]:
        for op, arg in nodes:
            part = one(op, arg)
            if part is not None and len(run) * len(part) <= FAN_OUT:
                run = {a + b for a, b in product(run, part)}
            elif op is _c.SUBPATTERN:
                run = walk(arg[-1], run)
            elif op is _c.MAX_REPEAT and arg[0] >= 1:
                run = close(run)
                walk(arg[2], run)
                run = {""}
            else:
                run = close(run)
        return run

    close(walk(_p.parse(pattern), {""}))
    # a longer alternative around a shorter one asks for nothing more
    return [frozenset(a for a in c if not any(b != a and b in a for b in c)) for c in clauses]


def trigrams(s: str) -> list[str]:
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def index_plan(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str, int]]:
    """Rows (rule, clause, alternative, trigram, trigrams of the alternative)."""
    return [(r, c, a, t, len(ts)) for r, rule in enumerate(rules) for c, clause in enumerate(mandatory(rule.pattern)) for a, alt in enumerate(sorted(clause)) for ts in [trigrams(alt)] for t in ts]


def postings(df: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """The inverted index, kept to the trigrams that some rule asks for: (gram, id)."""
    low = df.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("_id", F.explode(hits).alias("_gram"))


def candidates(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, rules): for each id, the indexed rules whose Boolean query its postings meet.

    The postings are dealt by id once; a rule's clauses are then intersected there.
    """
    plan = index_plan(rules)
    grams = sorted({x[3] for x in plan})
    index = postings(df, id_col, text_col, grams)
    literals = df.sparkSession.createDataFrame(plan, "rule int, clause int, alt int, _gram string, of int")
    need = {r: len(mandatory(rule.pattern)) for r, rule in enumerate(rules)}
    needed = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    met = (
        index.repartition("_id").dropDuplicates(["_id", "_gram"]).join(F.broadcast(literals), "_gram")  # a row for each trigram of the rules: fixed size
        .groupBy("_id", "rule", "clause", "alt", "of").agg(F.count("*").alias("n")).where("n = of")
        .groupBy("_id", "rule").agg(F.countDistinct("clause").alias("n"))
    )
    return met.where(F.col("n") == needed[F.col("rule")]).groupBy("_id").agg(F.collect_set("rule").alias("_rules"))


def gate(rule: Rule) -> str:
    """A pattern found in every text that has a long enough match of the rule, and in fewer others.

    Where the whole match is measured and is a run of one class behind a part of fixed
    width, the run must have the characters that the part leaves. Else the rule itself,
    or what its failing tries pass over.
    """
    if rule.run or rule.behind:
        return rule.run or rule.behind + rule.pattern
    nodes = _p.parse(rule.pattern)
    op, arg = nodes[-1]
    if rule.group or not rule.pattern.endswith("]+") or op is not _c.MAX_REPEAT or tuple(arg[2].getwidth()) != (1, 1):
        return rule.pattern
    low, high = nodes[:-1].getwidth()
    return f"{rule.pattern[:-1]}{{{max(1, rule.least - low)},}}" if low == high else rule.pattern


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` for a value that is computed once, however often the body's lambdas ask for it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, step: str) -> str:
    """SQL for a non-empty array of longs: the fold of all elements before each, and at last of all, from 0 by ``step`` of (a, b).

    Folding every prefix anew takes the square of the length, and so does a fold that
    appends to an array, as each append copies it. Here the prefixes are folded in
    chunks of about the square root: length ** 1.5 small steps, and no UDF.
    """
    fold = f"(a, b) -> {step}"
    each = f"transform(sequence(0, size(xs)), i -> aggregate(slice(xs, CAST(i DIV w AS INT) * w + 1, i % w), element_at(upto, CAST(i DIV w AS INT) + 1), {fold}))"
    chunks = _let("upto", f"transform(sums, (s, c) -> aggregate(slice(sums, 1, c), 0L, {fold}))", each)
    sums = _let("sums", f"transform(sequence(0, CAST(size(xs) DIV w AS INT)), c -> aggregate(slice(xs, c * w + 1, w), 0L, {fold}))", chunks)
    return _let("xs", values, _let("w", "CAST(ceil(sqrt(size(xs))) AS INT)", sums))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_enough(rule: Rule) -> str:
    """The rule's pattern with its least length inside, where that can't change what is matched.

    So it is for runs of one class behind characters of that class: a match that is too
    short is the whole run, and no shorter part of it is long enough either.
    """
    nodes = _p.parse(rule.pattern)
    op, arg = nodes[-1]
    if rule.group or not rule.pattern.endswith("]+") or op is not _c.MAX_REPEAT or tuple(arg[2].getwidth()) != (1, 1):
        return rule.pattern
    lead = [a for o, a in nodes[:-1] if o is _c.LITERAL]
    held = re.compile(rule.pattern[rule.pattern.rindex("[") : -1])
    if len(lead) < len(nodes) - 1 or not all(held.fullmatch(chr(a)) for a in lead):
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(lead))},}}"


def matches(text: str, k: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's leftmost non-overlapping matches in the text (SQL), of which there must be one.

    The pieces between matches and the matches alternate, so running sums of their
    lengths are the offsets, in code points. Too short ones, and what failing tries have
    passed over, are dropped afterwards.
    """
    pattern = _quoted(f"({rule.pattern})|{rule.run}" if rule.run else rule.behind + long_enough(rule))
    full = f"regexp_extract_all({text}, {pattern}, 0)"
    tested = f"regexp_extract_all({text}, {pattern}, {1 if rule.run else rule.group})"
    steps = f"zip_with(split({text}, {pattern}, -1), {full}, (g, m) -> named_struct('gap', CAST(length(g) AS BIGINT), 'len', CAST(coalesce(length(m), 0) AS BIGINT)))"
    span = f"named_struct('start', element_at(b, i + 1) + x.gap, 'kind', {k}, 'end', element_at(b, i + 1) + x.gap + x.len)"
    spans = _let("ys", steps, _let("b", _before("transform(ys, y -> y.gap + y.len)", "a + b"), f"transform(slice(ys, 1, size(ys) - 1), (x, i) -> {span})"))
    kept = f"filter(zip_with({spans}, {tested}, (x, t) -> named_struct('x', x, 'ok', length(t) >= {rule.least})), p -> p.ok)"
    return F.expr(f"transform({kept}, p -> p.x)")


_NONE = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` with ``secrets``: its spans by start, then by kind.

    A null text has no spans. Rows that share an id (or have none) are each judged by
    their own text; the index only says which rules are worth trying. Every match of
    a rule contains its mandatory trigrams, so leaving the others out loses nothing;
    rules without mandatory trigrams are tried on every text. An empty table gives an
    empty result. ``secrets``, ``_id`` and ``_rules`` replace such columns.

    The candidates are written as a table, so that the join's plan follows from its known
    size: few are broadcast under Spark's own limit, and no text is shuffled; many are
    joined by id. A text of n characters with m matches takes n + m ** 1.5 steps.
    """
    df = df.drop("secrets", "_id", "_rules")
    indexed = [k for k, r in enumerate(rules) if mandatory(r.pattern)]
    found = Scratch(df.sparkSession, "candidates").keep(candidates(df, id_col, text_col, rules), "found") if indexed else None
    said = f"coalesce(`{text_col}`, '')"
    text, none = F.expr(said), F.array().cast(_NONE)
    if found is not None:
        df = df.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    parts = []
    for k, rule in enumerate(rules):
        quick = text.rlike(gate(rule))
        wanted = F.coalesce(F.array_contains("_rules", k), F.lit(False)) & quick if k in indexed else quick
        parts.append(F.when(wanted, matches(said, k, rule)).otherwise(none))
    spans = F.array_sort(reduce(lambda a, b: F.concat(a, b), parts))
    return df.withColumn("secrets", spans).drop("_id", "_rules")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """Replace every span of ``secrets`` in the text by ``[secret]``, and drop ``secrets``.

    Spans that overlap become one. The rest of the text is untouched; null stays null.
    The text is cut in an encoding of equal widths, where a cut needs no search.
    """
    text = f"`{text_col}`"

    def cut(begin: str, end: str) -> str:
        return f"decode(substring(wide, CAST(4 * {begin} + 1 AS INT), CAST(greatest(4 * ({end} - {begin}), 0L) AS INT)), 'UTF-32')"

    shown = f"transform(secrets, (x, i) -> CASE WHEN x.start >= element_at(upto, i + 1) THEN concat({cut('element_at(upto, i + 1)', 'x.start')}, '[secret]') ELSE '' END)"
    joined = f"concat(array_join({shown}, ''), {cut('element_at(upto, -1)', f'length({text})')})"
    done = _let("wide", f"encode({text}, 'UTF-32')", _let("upto", _before("transform(secrets, x -> x.end)", "greatest(a, b)"), joined))
    return df.withColumn(text_col, F.expr(f"CASE WHEN size(secrets) > 0 THEN {done} ELSE {text} END")).drop("secrets")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    base = [k for k, r in enumerate(RULES) if r.base]

    def number(k: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")

    n = {RULES[k].kind: number(k) for k in base}
    first = F.filter("secrets", lambda x: x["kind"] < len(base))
    return got.select("doc_id", *[c.alias(f"n_{k}") for k, c in n.items()], F.sha2(listed(first), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """The scan in DuckDB's SQL: each rule over every text, no index."""
    each = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT rid, {k} AS k, '{r.kind}' AS kind, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n, length(gs[i]) AS g, {r.least} AS least"
            f" FROM (SELECT rid, ms, gaps, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {r.group}) AS gs FROM texts WHERE regexp_matches(t, '{p}')))"
        )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT rid, k, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({" UNION ALL ".join(each)}) WHERE g >= least),
listed AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (rid)
"""


OP9_SQL = _sql()
