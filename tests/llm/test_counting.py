"""Counts against the tokenizers library's own unigram model."""

import random

import pytest

from quire.llm import counting, tokens

PATH = tokens.vocabulary("piece_bpe_32k.model")


def library(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("tied", [False, True])
def test_like_the_library(tied):
    pieces = counting.vocabulary(PATH)
    if tied:  # whole scores: many paths of equal score
        pieces = [(p, float(-(i % 3))) for i, (p, _) in enumerate(pieces)]
    mine, theirs = counting.Counter(pieces), library(pieces)
    rng = random.Random(2)
    alphabet = [*"abcdefgs  \n\t.,▁é中😀\u0000", "the", "ing", " of"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "  a", "▁", "x" * 4000]
    assert mine.many(texts) == [theirs(x) for x in texts]


def test_small_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        pieces = [("<unk>", 0.0)] + [(p, float(rng.randint(-3, 0))) for p in sorted({"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(8)})]
        mine, theirs = counting.Counter(pieces), library(pieces)
        texts = ["".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(50)]
        assert mine.many(texts) == [theirs(x) for x in texts]


def test_whole_table(spark):
    theirs = library(counting.vocabulary(PATH))
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: theirs(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in counting.op8(spark, sf).collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (None, "a b", "z")], "doc_id long, text string, n_tokens string")
    n = library(counting.vocabulary(PATH))("a b")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counting.count(df, "doc_id", "text", PATH).collect()) == [(0, n), (1, 0), (1, n)]
    assert counting.count(df.limit(0), "doc_id", "text", PATH).collect() == []
