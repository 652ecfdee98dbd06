from __future__ import annotations

import numpy as np

from stockledger.llm import lm


def test_words_with_symbols_of_their_own_grow_with_the_vocabulary():
    sizes = [lm.sizes_of(10**k) for k in range(4, 9)]
    assert sizes[0] == (1536, 256)
    assert all(b[0] > 4 * a[0] and b[1] > 4 * a[1] for a, b in zip(sizes[2:], sizes[3:], strict=False))


def test_every_pair_is_visited_and_weighs_its_count():
    n = np.random.default_rng(1).zipf(1.5, 5000).astype(float)
    pair, weight = lm.visits_of(n)
    assert len(np.unique(pair)) == len(n) and len(pair) <= 2 * len(n) + 1
    assert np.allclose(np.bincount(pair, weights=weight) * n.mean(), n, rtol=1e-4)


def test_partitions_trained_apart_are_one_model_and_norms_are_exact(spark):
    symbols = 30
    rows = [(k * (symbols + 1) + (k + 1) % symbols, 50_000) for k in range(symbols)] + [(symbols * (symbols + 1), 25_000)]
    pairs = spark.createDataFrame(rows, "pair long, n long").repartition(3)
    unigram = np.full(symbols, 1 / symbols)
    model = lm.trained(pairs, unigram, steps=600, block=8).parameters()
    table = lm.log_probabilities(*model)
    assert (table[:symbols].argmax(axis=1) == (np.arange(symbols) + 1) % symbols).mean() > 0.9
    shared = spark.sparkContext.broadcast(model)
    scores = model[0] @ model[1].T + model[2]
    assert np.allclose(scores - lm.norms_in_tasks(spark, shared, symbols + 1, block=8)[:, None], table, atol=1e-4)
    assert np.allclose(lm.norms(model, block=7, wide=4), lm.norms(model), atol=1e-5)
