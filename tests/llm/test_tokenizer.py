import pytest

from tessera.llm import tokenizer as T

TEXTS = [
    None, "", " ", "plain words, and more.", "don't we'LL 'tis", "<|endoftext|> stays text", "x" * 5000, " " * 300 + "a", "\n\n\t \r\n", "日本語のテキスト、漢字。", "ไทยไม่มีช่องว่าง",
    "हिन्दी में", "العربية؟", "é decomposed", "👩‍🔬 ​﻿", "a\x1cb\x85c　d", "12,345.67 ٣٤", "\x00\x01",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_equals_public_tokenizer_and_round_trip(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    ids = T.encode_texts(df, "id", "text")
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert got == {k: reference(t) for k, t in enumerate(TEXTS)}
    back = {r["id"]: r["text"] for r in T.decode_ids(ids, "id").collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}


def test_corpus(spark, root, reference):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: reference(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in T.encode_texts(docs, "doc_id", "text").collect()} == want


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([(None, "a")], "id long, text string")
    assert [tuple(r) for r in T.encode_texts(df, "id", "text").collect()] == [(None, [64])]
    assert T.encode_texts(df.limit(0), "id", "text").count() == 0
