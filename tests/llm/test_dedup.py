from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stockledger.llm import chunks, suffixes


def brute_strings(docs, span):
    texts = {d: (t or "").encode() for d, t in docs}
    count = Counter(b[i : i + span] for b in texts.values() for i in range(len(b) - span + 1))
    out = {}
    for d, b in texts.items():
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                mark[i : i + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    draw = random.Random(seed)
    text = lambda n, letters="abc dé": "".join(draw.choice(letters) for _ in range(n))
    shared, docs = [text(draw.choice([50, 58, 60, 61, 70, 200])) for _ in range(8)], []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(shared)
            parts += [text(draw.choice([0, 1, 2, 50]), "efghij"), p if draw.random() < 0.6 else p[: draw.randint(0, len(p))]]
        docs.append((i, "".join(parts)))
    return docs + [(201, ""), (202, None), (203, "a" * 200), (204, "ab" * 100), (205, docs[5][1])]


@pytest.mark.parametrize("crowd", [3, 400])
def test_strings_found_twice_are_those_of_a_plain_count(spark, monkeypatch, crowd):
    docs = passages(crowd)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string").repartition(3)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    found = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(frame, span=60).collect()
    }
    assert found == brute_strings(docs, 60)


def test_suffixes_sort_like_their_bytes_in_their_groups():
    draw = random.Random(3)
    strings = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 12))).encode() for _ in range(200)]
    groups = np.sort(np.asarray([draw.randint(0, 4) for _ in strings]))
    found = suffixes.Suffixes(strings, groups)
    order = found.order().tolist()
    assert order == sorted(range(200), key=lambda i: (groups[i], strings[i], i))
    common = found.neighbours(np.asarray(order))
    for k in range(1, 200):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if groups[order[k - 1]] == groups[order[k]] else 0)


def test_hash_collisions_are_found_by_the_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "_BYTE", np.zeros(256, dtype=np.uint64))  # every string has the same hash
    found = suffixes.Suffixes([b"abcd", b"abxd"], np.zeros(2, dtype=int))
    assert found.common(np.array([0]), np.array([1])).tolist() == [2]


def test_suffix_dedup_without_rows_or_ids(spark):
    frame = spark.createDataFrame([(None, "a" * 1000), (1, "b" * 399)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.deduplicated(frame).collect()) == [0, 1000]  # a text of its own, without an id
    assert suffixes.deduplicated(frame.limit(0)).count() == 0


def test_chunk_ends_move_only_near_an_insertion_and_keep_characters_whole():
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefgh éß\n") for _ in range(4000)).encode()
    ends = chunks.ends_of(text)
    assert ends[-1] == len(text) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= chunks.MOST + 3
    for end in ends[:-1]:
        text[:end].decode()
    longer = text[:2000].decode(errors="ignore").encode() + b"XY" + text[len(text[:2000].decode(errors="ignore").encode()) :]
    own, other = set(chunks.digests_of(text, ends)), set(chunks.digests_of(longer, chunks.ends_of(longer)))
    assert len(own - other) <= 4
    assert chunks.ends_of(b"").tolist() == [] and chunks.ends_of(b"a" * 1000).tolist()[-1] == 1000


def test_repeated_passages_go_and_first_holders_keep_them(spark):
    draw = random.Random(6)
    words = lambda n: " ".join("".join(draw.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    passage, a, b, c = words(60), words(80), words(80), words(30)
    rows = [(3, f"{a} {passage} {a[:0]}", 0), (2, f"{b} {passage} {c}", 0), (4, c[:50], 0), (5, None, 0), (6, "", 0), (None, passage, 0), (7, f"{passage} {passage}", 0)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_chars int, repeated string")
    found = {r.doc_id: r for r in chunks.rewritten(frame).collect()}
    assert found[2].text == rows[1][1] and found[None].text == passage and found[4].text == c[:50]
    assert len(found[3].text) < len(rows[0][1]) - 200 and a[:300] in found[3].text
    assert len(found[7].text) < 250 and found[5].text is None and found[6].text == "" and found[5].n_chars is None
    assert found[3].n_chars == len(found[3].text) and found[3].repeated == "z"
    rows = {r.doc_id: r for r in chunks.deduplicated(frame).collect()}
    assert all((rows[d].kept or "") == (found[d].text or "") for d in found)
    assert rows[3].n_removed == rows[3].n_bytes - len(found[3].text) and rows[2].n_spans == 0
    assert chunks.rewritten(frame.limit(0)).count() == 0
