"""Operator 9 against the tokenizers library, and exact round trips."""

import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weir.llm import bpe
from weir.llm.queries import QUERIES
from weir.llm.shared import table

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())
OURS = bpe.TrieBpe(bpe.default_vocabulary())
SIGNS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "١", "1", ".", "!!", "　", "\x85", "\x1c", "<|endoftext|>", "=====", "the ", " token", "😀", "\xa0", "_", "\r\n"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def got(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in OURS.encode_batch(texts)]


def test_random_texts_match_the_library():
    rng = random.Random(7)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(3000)]
    assert got(texts) == [ids(t) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " =" * 2000, "\n" * 500 + "x", "the " * 4000, "<|endoftext|>" * 3])
def test_edges_match_the_library(text):
    assert got([text]) == [ids(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_and_round_trips(text):
    assert got([text]) == [ids(text)]
    assert OURS.decode(OURS.encode_batch([text])[0]).decode() == text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1)
    fresh = bpe.TrieBpe(bpe.default_vocabulary())
    text = "some words and more words, again and again"
    assert fresh.encode_batch([text]) == fresh.encode_batch([text]) == OURS.encode_batch([text])


def test_query_over_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "hello world", None), (3, "", "y"), (4, "z" * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encode(df, "doc_id", "text").collect()}
    assert out == {(i, len(ids(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_decode_ids_gives_texts_back(spark):
    df = spark.createDataFrame([(1, "some text – ok"), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert {(r.doc_id, r.text) for r in back.collect()} == {(1, "some text – ok"), (2, "")}


def test_query_on_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    out = QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs)
    for r in out:
        own = np.array(ids(docs[r.doc_id]), "<u4")
        decoded = LIBRARY.decode(own.tolist(), skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}])
def test_other_vocabularies_are_refused(tmp_path, change):
    with open(bpe.default_vocabulary(), encoding="utf-8") as file:
        spec = json.load(file)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec | change))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.TrieBpe(str(path))
