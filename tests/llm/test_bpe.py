from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stockledger.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


def ids_of(codec, text: str) -> list[int]:
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abehTH'sdlr \n\t\r  éñß中😀0123.,!?-_")), max_size=60))
def test_ids_are_those_of_the_reference_library_and_decode_back(text):
    codec = bpe.codec(PATH, PATTERN)
    assert ids_of(codec, text) == OTHER.encode_ordinary(text)
    assert "".join(codec.decode(codec.encode(text), block=3)) == text


def test_states_beyond_the_bound_are_followed_without_being_made(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    codec = bpe.Codec(PATH, PATTERN)
    text = "unbelievably antidisestablishmentarianism ouwheaerthlyes tionanonou" * 3
    assert ids_of(codec, text) == OTHER.encode_ordinary(text)


def test_a_very_long_word_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 4)
    codec = bpe.Codec(PATH, PATTERN)
    text = "x" * 20_000 + " " + "ab" * 5_000 + " " + " ".join(f"w{i}" for i in range(50))
    assert ids_of(codec, text) == OTHER.encode_ordinary(text)


def test_decoder_waits_for_the_rest_of_a_character():
    machine = bpe.Utf8Machine()
    raw = "a😀é".encode()
    assert [machine.feed(raw[i : i + 1]) for i in range(len(raw))] == ["a", "", "", "", "😀", "", "é"]
    assert machine.close() == ""
    machine.feed(b"\xf0\x9f")
    assert machine.close() == "�"


def test_documents(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "é", "x"), (1, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.round_trip(docs, PATH, PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    for r in found:
        text = {1: "hello world", None: "é"}.get(r.doc_id, "")
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.valid_utf8
        assert r.ids_sha256 == (hashlib.sha256(bytes(r.ids)).hexdigest() if text else empty)
    encoded = bpe.encode_documents(docs, PATH, PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, PATH, PATTERN).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: "é"}
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
