"""Fill-in-middle: the rope against plain strings, rows against a plain rearrangement."""

import hashlib
import random
import re

import pytest

from quire.llm import fim

ALPHABET = ["a", "bc", "\n", "\n\n", " ", "é", "中", "😀", "\r", " ", "<", "P>", "<P", ">"]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 4096])
def test_rope_like_strings(leaf):
    rng = random.Random(leaf)
    for _ in range(150):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 40)))
        rope, units = fim.Rope.of(text, leaf), lines(text)
        assert (str(rope), rope.chars, rope.units()) == (text, len(text), len(units))
        for u in range(len(units) + 2):
            a, b = rope.after_units(u)
            assert (str(a), str(b)) == ("".join(units[:u]), "".join(units[u:]))
            assert (a.units(), b.units()) == (len(units[:u]), len(units[u:]))
        c = rng.randint(0, len(text))
        a, b = rope.after_chars(c)
        assert (str(a), str(b)) == (text[:c], text[c:])
        assert str(b + a) == text[c:] + text[:c] and (b + a).chars == len(text) and (b + a).ends == text.count("\n")


def plain(doc, text, percent, spm):
    """(n, form, prefix characters, middle characters, output) without a rope."""
    text = text or ""
    units = lines(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(3)
    long = "".join(rng.choices(["word ", "line\n", "é", "\n"], k=60_000))
    return [None, "", "\n", "\n\n\n", "x", "x\n", "one <S> two\nthree", "<P>", "<<\n<P\n<", "S>\nM>\nP>", "n" * 30_000, long, "same\ntext\n", "same\ntext\n"] + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_rows(spark, percent, spm):
    rows = [(i if i % 40 else None, t, "mine", 1, "other") for i, t in enumerate(odd_texts())]
    rows += [(3, "again\nand again", "mine", 1, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long, form string").repartition(3)
    got = fim.restore(fim.transform(df, "doc_id", "text", percent, spm)).collect()
    want = [(d, *plain(d, t, percent, spm), t or "") for d, t, *_ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert fim.restore(fim.transform(df.limit(0), "doc_id", "text")).collect() == []


def test_restoring_needs_form_and_output_alone(spark):
    df = spark.createDataFrame([("psm", "<P>a\n<S>c<M>b\n", 7), ("spm", "<S>c<P>a\n<M>b\n", 8), ("plain", "<P>x", 9), (None, "x", 1), ("psm", None, 2)], "form string, output string, restored long")
    assert [r.restored for r in fim.restore(df).collect()] == ["a\nb\nc", "a\nb\nc", "<P>x", None, None]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        *some, out = plain(r.doc_id, r.text, 100, 50)
        want.append((r.doc_id, *some, sha(out), sha(r.text or "")))
    assert sorted(map(tuple, fim.op11(spark, sf).collect())) == sorted(want)
