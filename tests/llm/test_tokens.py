"""Token ids, token files and packing against the tokenizers library, text by text."""

import gc
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import packing, token_files, tokens
from quire.llm.common import shared_dir

VOCAB = tokens.vocabulary("byte_bpe_50k.json")
ODD = ["", None, "a", "  two  spaces ", "x <|endoftext|> y", "don't\n\n stop, 12.5!\nNext", "é 中 😀", "word " * 3000, "n" * 5000]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_is_exact():
    enc = tokens.Encoder(VOCAB)
    rng = random.Random(4)
    alphabet = [*"ab '\n\t s.,1é 中😀<>", "<|endoftext|>", "don't", " the", "  ", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ODD
    got = [np.frombuffer(x, enc.dtype).tolist() + [0] for x in enc.many(texts)]
    assert got == expected(texts)


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 8)
    enc = tokens.Encoder(VOCAB)
    texts = [f"one two three {i} four, five.\nsix" for i in range(40)]
    for t, e in zip(texts, expected(texts)):
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() + [0] == e


def test_words_start_where_the_pattern_cuts():
    pattern = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{tokens._L}]+| ?[{tokens._N}]+| ?[^ \t\r\n{tokens._L}{tokens._N}]+|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]+")
    rng = random.Random(7)
    alphabet = [*"aestmdlrv'''  \n\t\r.1é²ß×", "ſ", "'ll", "'re", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(5000)]
    data = "\0".join([*texts, ""]).encode()
    at = [*tokens.word_starts(np.frombuffer(data, np.uint8)).tolist(), len(data)]
    assert [data[a:b].decode() for a, b in zip(at, at[1:])] == [w for t in texts for w in [*pattern.findall(t), "\0"]]


def test_files_with_other_steps_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(VOCAB)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.save(f"{tmp_path}/prefix.json")
    enc = tokens.Encoder(f"{tmp_path}/prefix.json")
    texts = ["one two\nthree", "x  y", "中 文"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_take_less_time_than_all_steps_of_the_library():
    """The whole way of texts whose words are all new, against the library's own calls for these words."""
    rng = random.Random(5)
    words = list({"".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(40_000)})
    texts = [" ".join(["", *words[i : i + 400]]) for i in range(0, len(words), 400)]

    def least(work):
        took = []
        for _ in range(3):
            enc, start = tokens.Encoder(VOCAB), time.process_time()
            work(enc)
            took.append(time.process_time() - start)
        return min(took)

    library = least(lambda enc: [e.ids for e in enc.tok.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)])
    assert least(lambda enc: enc.many(texts)) < 0.95 * library


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long").repartition(parts)


@pytest.mark.parametrize("length", [4, 1024])
def test_files_round_trip(spark, length):
    texts = ODD * 3
    uri = f"{shared_dir(spark)}/test-files-{length}"
    shards = token_files.write(frame(spark, texts), "doc_id", "text", uri, VOCAB, length)
    rows = sorted(token_files.read(spark, shards, uri).collect())
    want, at = expected(texts), 0
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, e in zip(rows, want):
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(e), e)
        at += len(e)
    first = min(r.shard for r in shards.collect())
    reader = token_files.ShardReader(uri, first)
    flat = [x for e in want for x in e]
    ids, mask = reader.sequence(1 if length == 4 else 0)
    k = length if length == 4 else 0
    n = int(mask.sum())
    assert ids[:n].tolist() == flat[k : k + n] and not ids[n:].any()


def test_masks_are_views(spark):
    uri = f"{shared_dir(spark)}/test-masks"
    shards = token_files.write(frame(spark, ODD * 3), "doc_id", "text", uri, VOCAB, 4)
    reader = token_files.ShardReader(uri, min(r.shard for r in shards.collect()))
    before = pa.total_allocated_bytes()
    masks = [reader.mask(i) for i in range(3)]
    assert pa.total_allocated_bytes() == before
    assert [m.to_pylist() for m in masks] == [reader.sequence(i)[1].tolist() for i in range(3)]


def test_files_of_nothing(spark):
    uri = f"{shared_dir(spark)}/test-nothing"
    shards = token_files.write(frame(spark, []), "doc_id", "text", uri, VOCAB)
    assert token_files.read(spark, shards, uri).collect() == []


def test_files_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (None, None)], "doc_id long, text string")
    uri = f"{shared_dir(spark)}/test-null"
    rows = token_files.read(spark, token_files.write(df, "doc_id", "text", uri, VOCAB), uri).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 2), (False, 2), (True, 1), (True, 3)]


@pytest.mark.parametrize("block", [1, 3000, packing.BLOCK])
def test_packing_is_a_partition(spark, block):
    texts = ODD * 4
    df = frame(spark, texts)
    rows = packing.pack(df.coalesce(1) if block == packing.BLOCK else df, "doc_id", "text", VOCAB, block=block).collect()
    want = expected(texts)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, e in enumerate(want):
        parts = sorted(docs[d], key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4")] == e
        assert {r.doc_tokens for r in parts} == {len(e)}
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        assert sum(r.length for r in s) <= 1024
    if block == packing.BLOCK:
        assert len(seqs) == -(-sum(map(len, want)) // 1024)


def test_assign_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(1, 700) for _ in range(400)]
    placed = packing.assign(lengths)
    cost = defaultdict(float)
    for _, _, n, s, _ in placed:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    arrived, used = defaultdict(float), defaultdict(int)
    for i, n in enumerate(lengths):  # in the order given, first fit
        s = next(k for k in range(10**6) if used[k] + n <= 1024)
        used[s] += n
        arrived[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert np.std(list(cost.values())) < np.std(list(arrived.values()))


def naive_assign(lengths, capacity):
    """Every sequence is looked at for every piece."""
    pieces = [(n, i, 0) for i, n in enumerate(lengths)]
    seqs = [[0.0, capacity] for _ in range(-(-sum(lengths) // capacity))]
    out = []
    while pieces:
        k = min(range(len(pieces)), key=lambda k: -pieces[k][0])  # the first of the longest
        n, piece, at = pieces.pop(k)
        fits = [s for s in range(len(seqs)) if seqs[s][1] >= n]
        s = min(fits or [s for s in range(len(seqs)) if seqs[s][1]], key=lambda s: (seqs[s][0], s))
        m = min(n, seqs[s][1])
        out.append((piece, at, m, s, capacity - seqs[s][1]))
        seqs[s][0] += packing.LINEAR * m + packing.QUADRATIC * m * m
        seqs[s][1] -= m
        if m < n:
            pieces.append((n - m, piece, at + m))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_assign_like_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 1024])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (capacity / rng.choice([2, 3, 8]))))) for _ in range(rng.randint(1, 200))]
    assert packing.assign(lengths, capacity) == naive_assign(lengths, capacity)


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, []), "doc_id", "text", VOCAB).collect() == []


def test_queries_match_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    want, at = {}, 0
    for (d, _), e in zip(docs, expected([t for _, t in docs])):
        want[d] = (at, len(e), crc(e), e)
        at += len(e)
    got = token_files.op2(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == {d: v[:3] for d, v in want.items()}
    for r in packing.op3(spark, sf).collect():
        e = want[r.doc_id][3]
        assert r.doc_tokens == len(e) and r.ids_crc32 == crc(e[r.start : r.start + r.length])


def test_workers_let_go_of_another_operators_words(spark):
    """Packing's tokenizer and words aren't in memory while the tasks of another stage run in the same worker."""
    from quire.llm import common

    docs = spark.createDataFrame([(1, "some words to remember")], "doc_id long, text string").coalesce(1)

    def names(batches):
        from quire.llm import tokens

        for b in batches:
            found = sum(isinstance(x, tokens.Encoder) for x in gc.get_objects())
            yield pa.record_batch([pa.array([found] * b.num_rows, pa.int64())], names=["n"])

    assert packing.pack(docs, "doc_id", "text", VOCAB).count() == 1
    assert [r.n for r in docs.transform(common.in_batches, names, "n long", VOCAB).collect()] == [1]
    assert [r.n for r in docs.transform(common.in_batches, names, "n long").collect()] == [0]
    assert packing.pack(docs, "doc_id", "text", VOCAB).count() == 1
