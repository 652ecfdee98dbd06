"""Suffix dedup where ids are repeated or null: each row is a text of its own."""

from __future__ import annotations

import random

from stockledger.llm import suffixes
from tests.llm.test_dedup import brute_strings


def test_repeated_and_null_ids(spark):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdefg ") for _ in range(n))
    long, shared = text(6000), text(500)
    rows = [(1, long), (1, "short text"), (2, long[:3000] + "x" + long[3000:]), (None, shared + text(100)), (None, text(90) + shared)]
    rows += [(7, text(900)), (7, text(900)), (None, None), (None, ""), (3, text(450) * 2)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, number int").repartition(3)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(frame).collect()]
    plain = brute_strings([(i, t) for i, (_, t) in enumerate(rows)], suffixes.SPAN)
    assert sorted(found, key=repr) == sorted(((rows[i][0], *counts) for i, counts in plain.items()), key=repr)
    assert sum(n for _, _, n, _, _ in found) > 10_000
