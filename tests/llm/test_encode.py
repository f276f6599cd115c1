import pytest
from tokenizers import Tokenizer

from tapeloom.llm.encode import Encoding, count_tokens, decode_corpus, encode_corpus

TEXTS = [None, "", " ", "\n\n  x", "It's  o'clock, 'll they're", "naïve Straße ﬁ 東京 👩‍👩‍👧", "a" * 5000, "<|endoftext|> is text", "tab\tand nbsp　wide", "x\x1f\x1cy\x85z w", "repeated", "repeated", "١٢٣ 12 ½", "word " * 3000, "﻿​ zero", "é combining"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(Encoding().vocabulary)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def frame(spark, texts):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block int")


def test_ids_equal_whole_text_encoding(spark, reference):
    for block in (10, 4_000_000):
        got = {r.doc_id: r.ids for r in encode_corpus(frame(spark, TEXTS), Encoding(block_chars=block)).collect()}
        assert got == {i: reference(t) if t else [] for i, t in enumerate(TEXTS)}


def test_real_texts_and_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    encoded = encode_corpus(docs)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {d: reference(t) if t else [] for d, t in texts.items()}
    back = {r.doc_id: r.text for r in decode_corpus(encoded).collect()}
    assert back == {d: t or "" for d, t in texts.items()}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    assert counts == {d: len(x) for d, x in got.items()}


def test_empty_table(spark):
    assert encode_corpus(frame(spark, [])).count() == 0
