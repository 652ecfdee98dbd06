from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stockledger.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, note int"


def plain(docs, budget=None, cycle=(1, 2, 3), limit=3):
    """Targets round by round in fractions, then each source's documents one by one in the order of their keys."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    words = {s: sum(size(d[1]) for d in docs if d[2] == s) for s in sources}
    total = sum(words.values()) if budget is None else budget
    target, open_ = {}, set(sources)
    while True:
        left = total - sum(target.values())
        share = {s: Fraction(weight[s] * left, sum(weight[x] for x in open_)) for s in open_}
        above = {s for s in open_ if share[s] > limit * words[s]}
        if not above:
            break
        target |= {s: Fraction(limit * words[s]) for s in above}
        open_ -= above
        if not open_:
            break
    target |= {s: share[s] for s in open_}
    found = []
    for s in sources:
        budget_words, own = int(target[s]), [d for d in docs if d[2] == s]
        key = lambda d: hashlib.md5(f"{'' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest()[:15]
        epochs, rest = divmod(budget_words, words[s]) if words[s] else (0, 0)
        for d in sorted(own, key=lambda d: (key(d), str(d[0]))):
            here = min(rest, size(d[1]))
            rest -= here
            found.append((d[0], size(d[1]), words[s], float(target[s]), epochs * size(d[1]) + here))
    return sorted(found, key=repr)


def documents():
    docs = [(i, " ".join(f"w{j}" for j in range(i % 23)) + " \t\x0b", "hot", "x", i) for i in range(90)]
    docs += [(i, "é ü x y z" * (i % 5), "ünï" if i % 2 else "z", None, i) for i in range(90, 130)]
    docs += [(200, "one two three four", "tiny", None, 0), (201, " \n\t ", "blank", None, 0), (202, None, None, None, 0)]
    docs += [(None, "a b c d e", None, None, 1), (None, "a b c d e", None, None, 2), (None, "f g", "hot", None, 3)]
    docs += [(5, "same id other text", "hot", None, 4), docs[7], docs[7], (203, "long " * 30_000, "z", None, 5)]
    return docs


@pytest.mark.parametrize("budget", [None, 0, 17, 10_000, 10**9])
def test_as_counted_one_by_one(spark, budget, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    docs = documents()
    mixed = mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(3), budget=budget)
    got = mixed.collect()
    assert sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=repr) == plain(docs, budget)
    assert mixed.columns == ["doc_id", "text", "source", "note", "size", "source_size", "target", "taken", "copies", "start"]
    by_source = {}
    for r in got:
        words, target = by_source.get(r.source, (0, r.target))
        by_source[r.source] = words + r.taken, target
        assert r.taken <= 3 * r.size and r.copies == (-(-r.taken // r.size) if r.size else 0)
    assert all(words == int(target) for words, target in by_source.values())


def test_mixture_has_the_words_taken(spark):
    docs = documents()
    frame = spark.createDataFrame(docs, SCHEMA)
    taken = sum(r[4] for r in plain(docs))
    rows = mixing.mixture(frame).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == taken
    whole = {d[1] for d in docs}
    cut = [r for r in rows if r.text not in whole]
    assert 0 < len(cut) <= len({d[2] for d in docs}) and all(any(w and w.startswith(r.text) for w in whole) for r in cut)
    assert max(r.epoch for r in rows) == 3


def test_given_weights_and_tables_without_words(spark):
    docs = [(i, "a b c d", "abc"[i % 3]) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3), ("b", 1), ("elsewhere", 5)], "source string, weight int")
    taken = dict(mixing.mix(frame, weights, 80).groupBy("source").sum("taken").collect())
    assert taken == {"a": 60, "b": 20, "c": 0}
    assert dict(mixing.mix(frame, weights, 240).groupBy("source").sum("taken").collect()) == {"a": 120, "b": 120, "c": 0}
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixture(frame.limit(0)).count() == 0
    blank = mixing.mix(frame.withColumn("text", F.lit(" "))).collect()
    assert {(r.size, r.target, r.taken) for r in blank} == {(0, 0.0, 0)}
