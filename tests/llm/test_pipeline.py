"""The pipeline's stages against brute force on the smallest table."""

import re

import corpus_pipeline as P

from quire.llm import decontamination, quality, secrets
from tests_llm_naive import linked  # noqa: E402


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = P.quality_rules(spark, docs, sf)
    assert kept.columns == list(P.COLUMNS)
    for r in kept.collect():
        assert not (len(rows[r.doc_id].text.split()) < 10)
        assert set(r.text.split("\n")) <= set(rows[r.doc_id].text.split("\n"))
    for d in set(rows) - {r.doc_id for r in kept.collect()}:
        c = quality.counts(rows[d].text)
        assert c[0] < 10 or 100 * c[4] > 20 * c[0]
    single = P.ngram_jaccard(spark, kept, sf)
    assert sorted(r.doc_id for r in single.collect()) == linked({r.doc_id: r.text for r in kept.collect()}, 5, 80)
    pure = P.benchmark_passages(spark, single, sf)
    for r in pure.collect():
        assert not any(i in decontamination.normal(r.text) for i in items)
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in pure.collect()}
    for d in gone:
        t = decontamination.normal(rows[d].text).decode()
        assert any(decontamination.distance(i.decode(), t) <= decontamination.EDITS * len(i) for i in items)
    safe = P.secret_scan(spark, pure, sf)
    assert sorted(r.doc_id for r in safe.collect()) == sorted(r.doc_id for r in pure.collect())
    out = P.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in safe.collect()}


def naive_secret_cut(text):
    """Every span of every rule, where spans that overlap become one."""
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[secret]")
        at = max(at, b)
    return "".join(out) + text[at:]


def odd_rows():
    own = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(own)]
    rows += [(6, own[0], "en", "b", 1), (7, own[1] + " more", "en", "b", 1), (3, own[3], "en", "a", 1), (8, None, "en", None, None), (9, "", None, None, 0), (10, " \n ", "en", "a", 3)]
    rows += [(None, own[4], "en", "a", 1), (None, None, None, None, None), (11, own[5] + " token=abcdef12 password: hunter22x", "en", "a", 1), (12, "long " + " ".join(f"v{i}" for i in range(60_000)), "en", "a", 1)]
    return [(*r, "x", 1, [1], *[7] * len(INNER)) for r in rows]


#: Names that the operators use inside.
INNER = "_gone gone _maybe maybe key row _row _b _k _n node root print cid component_id host removed lines_ d t spans verdict kept judged".split()
ODD = "doc_id long, text string, lang string, source string, n_chars long, secrets string, _id int, lines array<int>, " + ", ".join(f"{c} int" for c in INNER)


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    kept = P.quality_rules(spark, docs, sf)
    assert kept.columns == list(P.COLUMNS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] and len(r[1].split()) > 9)
    single = P.ngram_jaccard(spark, docs, sf)
    assert single.columns == list(P.COLUMNS)
    whole = P.jaccard.one_each(docs, k=5, percent=80)
    assert whole.columns == docs.columns and all(r[c] == 7 for r in whole.collect() for c in INNER)
    # 6 is a copy of 0, 7 nearly one of 1 and 11 of 5; 3 stands twice
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in single.collect()) == [-1, -1, 0, 1, 2, 3, 3, 4, 5, 8, 9, 10, 12]
    pure = P.benchmark_passages(spark, docs, sf)
    assert pure.columns == list(P.COLUMNS) and pure.count() == len(rows)
    safe = P.secret_scan(spark, docs, sf)
    assert safe.columns == list(P.COLUMNS)
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in safe.collect()) == sorted(str((r[0], t, None if t is None else len(t))) for r in rows for t in [None if r[1] is None else naive_secret_cut(r[1])])
    packed = P.pack_sequences(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and min(r.length for r in packed) == 1


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []


def test_lines_and_secrets_of_the_given_table(spark):
    """What the stages take out of texts, against brute force on every row."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.text for r in P.secret_scan(spark, docs, sf).collect()}
    assert got == {r.doc_id: None if r.text is None else naive_secret_cut(r.text) for r in docs.collect()}
    assert sum("[secret]" in (t or "") for t in got.values()) > 0
