"""Queries over whole texts and documents."""

import hashlib

import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["hex_roundtrip", "base64_roundtrip", "bom_decode"])
def test_codes_of_whole_texts(spark, name):
    texts, got = documents(spark), {r.doc_id: r for r in catalog.queries()[name](spark, SF).collect()}
    assert max(map(len, texts.values())) > 10_000
    for d, t in texts.items():
        if name == "bom_decode":
            assert (got[d].text or "") == t
        else:
            assert len(got[d][1]) == (2 * len(t.encode()) if name[0] == "h" else -(-len(t.encode()) // 3) * 4) and got[d].back == hashlib.md5(t.encode()).hexdigest()


def test_runs_of_whole_documents(spark):
    pages = {(r.doc_id, r.page_idx) for r in catalog.queries()["crop_translation"](spark, SF).collect()}
    kept = {(r.doc_id, r.page_idx) for r in catalog.queries()["dup_overlap_suppress"](spark, SF).collect()}
    assert kept == pages and max(p for _, p in kept) > 0
    docs = [r.docs for r in catalog.queries()["inverted_index"](spark, SF).collect()]
    assert min(docs) == 1
