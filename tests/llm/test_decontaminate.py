from __future__ import annotations

import re

import pytest

from stockledger.llm import decontaminate

WORDS = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"Before, {WORDS.upper()}! after"),
    (2, "one two three four five six seven eight nine"),
    (3, None),
    (4, ""),
    (5, "tiny item here, and ONE-TWO"),
    (6, " ".join(["éa b"] * 3000) + " " + WORDS),
    (7, f"{WORDS} and {WORDS}"),
]
ITEMS = [(10, WORDS), (9, "x y"), (8, None), (7, ""), (6, "tiny item"), (11, WORDS + " thirteen")]


def brute(text, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for item, item_text in ITEMS:
        own = cut(item_text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[i : i + size]:
                    hit |= set(range(p, p + size))
                    found.add(item)
    return len(words), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(*d, "extra") for d in DOCS], "doc_id long, text string, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_hits_and_items_are_those_of_a_plain_search(frames):
    found = {r.doc_id: (r.n_words, list(r.hits), sorted(r["items"])) for r in decontaminate.contamination(*frames).collect()}
    assert found == {d: brute(t) for d, t in DOCS}


def test_blocks_of_the_benchmark_give_the_same(frames, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    found = {r.doc_id: (r.n_words, list(r.hits), sorted(r["items"])) for r in decontaminate.contamination(*frames).collect()}
    assert found == {d: brute(t) for d, t in DOCS}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(*frames).collect()) == [2, 3, 4]


def test_report_and_longest_matches(frames):
    report = {r.doc_id: r for r in decontaminate.report(decontaminate.contamination(*frames)).collect()}
    assert report[1].n_hit == 12 and report[1].n_items == 2 and report[1].contaminated and not report[2].contaminated
    # Ids sort as strings: 10 before 11, and 6 after 10.
    assert report[3].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    longest = {(r.doc_id, r.item_id, r.doc_from, r.item_from, r.n_words) for r in decontaminate.matches(*frames).collect()}
    assert {(1, 10, 1, 0, 12), (7, 10, 0, 0, 12), (7, 10, 13, 0, 12), (5, 6, 0, 0, 2)} <= longest


def test_empty_tables_and_kept_columns(frames):
    docs, items = frames
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not any(r.hits for r in decontaminate.contamination(docs, items.limit(0)).collect())
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
