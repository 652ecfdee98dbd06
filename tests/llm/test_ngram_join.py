from __future__ import annotations

import random
import re

import numpy as np
import pytest

from stockledger.llm import ngram_join
from stockledger.llm.components import components


def shingles(text) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute(docs) -> dict:
    sets = {d: shingles(t) for d, t in docs}
    group = {d: d for d in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return {d: (len(sets[d]), group[d]) for d in sets}


def corpus(seed: int) -> list[tuple]:
    draw, docs = random.Random(seed), []
    for _ in range(25):
        base = [draw.choice("abcdefghijklmnop") * draw.randint(1, 3) for _ in range(draw.choice([3, 5, 6, 8, 12, 20, 60, 200]))]
        for _ in range(draw.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(words) + 1)
                words[at : at + draw.randint(0, 1)] = [draw.choice("QRstuv")] * draw.randint(0, 1)
            docs.append((len(docs), " ".join(words)))
    return docs + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \n\t"), (len(docs) + 3, "one"), (len(docs) + 4, "ONE")]


@pytest.mark.parametrize("crowd", [1, 8])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, crowd):
    # With crowds of one and blocks of four, every piece takes the way of the very common ones.
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK", 4 if crowd == 1 else 2048)
    docs = corpus(crowd)
    frame = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, n int, node string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(frame).collect()}
    assert found == brute(docs)


def test_linked_sets_share_a_piece_whatever_their_sizes():
    draw = np.random.default_rng(2)
    for n in [3, 4, 5, 7, 8, 15, 16, 17, 31, 64, 127, 128, 300, 1000]:
        for _ in range(30):
            x = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = draw.integers(0, n // 7 + 1)
            extra = draw.integers(0, n // 3 + 1)
            y = np.unique(np.concatenate([x[gone:], draw.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                assert set(ngram_join.pieces(x).tolist()) & set(ngram_join.pieces(y).tolist())
            a, b = (np.frombuffer(ngram_join.folded_sketch(v), dtype=np.uint8) for v in (x, y))
            size = min(len(a), len(b))
            distance = np.bitwise_count(ngram_join.folded(a, size) ^ ngram_join.folded(b, size)).sum()
            assert distance <= len(x) + len(y) - 2 * both


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (None, "x y"), (7, text.upper()), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(frame).collect()), key=str)
    assert found == sorted([(5, 4, 5), (5, 4, 5), (7, 4, 5), (8, 0, 8), (None, 1, None), (None, 4, 5)], key=str)
    assert ngram_join.linked(frame.limit(0)).count() == 0
    kept = ngram_join.representatives(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "8", "None", "None"]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(7, 7), (None, 3), (50, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(101, 141)}, **{i: 1 for i in range(2, 30)}}
