"""Token ids against two public encoders, and round trips."""

from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessara.llm import bpe
from tessara.sources.tables import table

FOLDER = Path(bpe.VOCABULARY).parent
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no public tokenizers here")
HARD = ["", " ", "a", "  two  spaces \n\n x", "I'll we've 'S don't", "<|endoftext|> is text", "é🙂🙂👨‍👩‍👧 Люгеймяк", "a" * 5000, "ab" * 3000, "\u0000​﻿", "1234567890.5,6", "\t\tb\n", "x" * 200 + " " * 300 + "y"]


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(str(FOLDER / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(own, reference):
    assert [own.encode(x) for x in HARD] == reference(HARD)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_any_text(own, reference, text):
    assert own.encode(text) == reference([text])[0]
    decode = {v: k for k, v in own.ranks.items()}
    assert b"".join(decode[i] for i in own.encode(text)) == text.encode("utf-8", "surrogatepass")


def test_all_documents(spark, tiny, own, reference):
    documents = table(spark, tiny, "documents", "doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    out = {r["doc_id"]: r["ids"] for r in bpe.encode(documents).collect()}
    assert out == dict(zip(texts, reference(list(texts.values()))))


def test_nulls_repeats_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (3, "hi hi", 7)], "doc_id long, text string, ids int")
    out = bpe.encode(frame)
    assert sorted((r["doc_id"], len(r["ids"])) for r in out.collect()) == [(1, 0), (1, 0), (2, 0), (3, 2)] and out.columns == ["doc_id", "ids"]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in bpe.encode(frame, counts=True).collect()) == [(1, 0), (1, 0), (2, 0), (3, 2)]
    assert bpe.encode(frame.limit(0)).count() == 0
