from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from stockledger.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, h int"


def plain_runs(words, least=12):
    """Every period at every place: longest stretches, each with its least period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def numbered(texts):
    numbers = {}
    ids = [numbers.setdefault(w, len(numbers)) for words in texts for w in words]
    return np.cumsum([0, *map(len, texts)]), np.asarray(ids, dtype=np.int64)


def test_runs_of_random_words():
    draw = random.Random(5)
    for turn in range(150):
        texts = []
        for _ in range(draw.randint(1, 6)):
            letters = "abc"[: draw.randint(1, 3)] if turn % 2 else "abcdefgh"
            words = [draw.choice(letters) for _ in range(draw.choice([0, 1, 11, 12, 13, 40, 90]))]
            for _ in range(draw.randint(0, 3)):
                unit = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
                at = draw.randint(0, len(words))
                words[at:at] = (unit * draw.randint(2, 9))[: draw.randint(2, 60)]
            texts.append(words)
        assert periodic.found_runs(*numbered(texts)) == [plain_runs(t) for t in texts]
        assert periodic.found_runs(*numbered(texts), least=5) == [plain_runs(t, 5) for t in texts]


def test_fibonacci_and_long_texts():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.found_runs(*numbered([b])) == [plain_runs(b)]
    n = 60_000
    (same, pairs, none) = periodic.found_runs(*numbered([["x"] * n, ["x", "y"] * n + ["x"], [str(i) for i in range(n)]]))
    assert same == [(0, n, 1)] and pairs == [(0, 2 * n + 1, 2)] and none == []
    blocks = [w for k in range(300) for w in [f"u{k % 7}"] * 15 + [f"v{k}"]]
    (found,) = periodic.found_runs(*numbered([blocks]))
    assert found == [(16 * k, 15, 1) for k in range(300)]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    most = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if most is None else (*most, 1000 * most[1] // most[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(found), *top, sha(lines), sha(kept)


def test_query_against_plain_search(spark, tmp_path):
    draw, docs = random.Random(6), []
    for i in range(300):
        words = [draw.choice("abcdéfg") for _ in range(draw.randint(0, 60))]
        docs.append((i, draw.choice([" ", "\n", " \t\x0b"]).join(words), "clash", 1))
    docs += [(None, "z " * 40, None, None), (None, None, None, None), (300, "", None, None), (301, None, None, None), docs[3], (3, "q " * 20, "", 0)]
    planted = next(i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs += [(planted, "one two three four", "", 0), (planted, "", "", 0), (planted, None, "", 0), (planted, "word " * 3000 + "end", "", 0)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain(d[0], d[1]) for d in docs), key=repr)
    assert periodic.periodic(spark.createDataFrame(docs, SCHEMA).limit(0)).count() == 0
    table = periodic.run_table(spark.createDataFrame([(1, "a b " * 8, "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in table] == [(1, 0, 16, 2)]
