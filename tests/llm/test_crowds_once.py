"""Pairs of crowded pieces: given by one piece, whatever the number of pieces their nodes share."""

import numpy as np
import pytest

from stockledger.llm import ngram_join


def test_pair_is_given_by_the_least_shared_piece_only(spark):
    nodes, pieces = 12, 30
    hashes = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 70, dtype=np.uint64))
    sketches = spark.createDataFrame([(i, 70, bytearray(ngram_join.folded_sketch(hashes))) for i in range(nodes)], "node long, n long, sketch binary")
    crowds = spark.createDataFrame([(p, i, 70) for p in range(pieces) for i in range(nodes)], "piece long, node long, n long").repartition(3)
    groups = spark.createDataFrame([(11, 0)], "node long, component long")
    cards = ngram_join.with_first_pieces(crowds, sketches)
    found = [tuple(r) for r in ngram_join.across(crowds, cards, groups, nearest=False).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in range(nodes) for b in range(a + 1, nodes) if (a, b) != (0, 11)}
    near = [tuple(r) for r in ngram_join.across(crowds, cards, groups, nearest=True).collect()]
    assert set(near) <= set(found) and len(near) <= nodes


@pytest.mark.parametrize("shared", [0, 7, 8, 20])
def test_no_pair_is_lost_beyond_the_first_pieces(spark, shared):
    # Two nodes have many pieces each, and one in common, the least or the last of them.
    sketch = bytearray(ngram_join.folded_sketch(np.arange(70, dtype=np.uint64)))
    sketches = spark.createDataFrame([(1, 70, sketch), (2, 70, sketch)], "node long, n long, sketch binary")
    rows = [(2 * p - 7, 1, 70) for p in range(21) if p != shared] + [(2 * p - 6, 2, 70) for p in range(21) if p != shared]
    rows += [(2 * shared - 7, 1, 70), (2 * shared - 7, 2, 70)]
    crowds = spark.createDataFrame(rows, "piece long, node long, n long").repartition(3)
    cards = ngram_join.with_first_pieces(crowds, sketches)
    for nearest in (False, True):
        found = ngram_join.across(crowds, cards, spark.createDataFrame([], "node long, component long"), nearest=nearest).distinct().collect()
        assert [tuple(r) for r in found] == [(1, 2)]
