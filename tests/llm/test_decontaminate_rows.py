"""Repeated and null ids of documents and items: the benchmark's blocks change nothing."""

from __future__ import annotations

import pytest

from stockledger.llm import decontaminate

WORDS = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_rows_and_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(
        [(1, WORDS), (1, "clean"), (None, f"{WORDS} tiny item"), (None, "also clean"), (2, None), (3, "nameless")], "doc_id long, text string"
    )
    items = spark.createDataFrame(
        [(10, WORDS), (10, WORDS), (5, "tiny item"), (10, "tiny item"), (None, "nameless"), (None, "nameless")], "item_id long, text string"
    )
    found = decontaminate.report(decontaminate.contamination(docs.repartition(2), items)).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found), key=repr)
    assert rows == sorted(
        [(1, 11, 11, 1, True), (1, 1, 0, 0, False), (None, 13, 13, 2, True), (None, 2, 0, 0, False), (2, 0, 0, 0, False), (3, 1, 1, 1, True)], key=repr
    )
    nothing = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(nothing) == 6 and not any(r.hits for r in nothing)
    places = {(r.doc_id, r.item_id, r.doc_from, r.n_words) for r in decontaminate.matches(docs, items).collect()}
    assert {(1, 10, 0, 11), (None, 5, 11, 2), (3, None, 0, 1)} <= places
