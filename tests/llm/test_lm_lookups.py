"""A token is looked up once, whatever is asked of it, and texts are taken many at a time."""

import numpy as np

from stockledger.llm import lm


def test_one_lookup_tells_head_words_from_classes():
    places = lm.Places([b"the", b"of", lm.END], classes=8)
    found = [places[w] for w in (b"of", b"rare", lm.END, b"rare")]
    assert found == [1, -1 - lm.class_of(b"rare", 8), 2, found[1]] and found[1] < 0
    symbols = lm.Symbols([b"the"], 8)
    assert symbols[b"rare"] == 1 - 1 - found[1]


def test_texts_in_a_row_begin_anew():
    tokens, starts = lm.tokens_in([b"A b", b"", b"c"])
    assert tokens == [b"a", b"b", lm.END, lm.END, b"c", lm.END] and starts.tolist() == [0, 3, 4]
    assert lm.before_of(np.arange(6), starts, 99).tolist() == [99, 0, 1, 99, 99, 4]


def test_pairs_of_all_texts_however_they_are_gathered(spark):
    rows = [(i, "x y x z" if i % 2 else "y") for i in range(50)] + [(50, None)]
    docs = lm.id_and_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    names, few = [b"x", b"y", lm.END], 4
    found = [{r.pair: r.n for r in lm.pair_counts(docs, names, few, flush=flush).collect()} for flush in (1, 1 << 20)]
    symbols = lm.Symbols(names, few)
    expected = {}
    for _, text in rows:
        after = symbols.of(lm.tokens_of((text or "").encode())).tolist()
        for pair in zip([symbols.start, *after[:-1]], after, strict=True):
            key = pair[0] * (symbols.start + 1) + pair[1]
            expected[key] = expected.get(key, 0) + 1
    assert found == [expected, expected]
