from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from stockledger.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank int, n string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, support, covered=100, limit=None):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if len(p) > 2 and a >= support}
    dropped = set()
    for p, a in often.items():
        words = p[1:]
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (p[0], *words[i : i + k])
                if 100 * a >= covered * counts[part]:
                    dropped.add(part)
    rows = {}
    for p, a in often.items():
        if p in dropped:
            continue
        lang, words, cuts = p[0], p[1:], []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    found = []
    for lang, own in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:limit], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def documents():
    draw, docs = random.Random(8), []
    common = ["The quick Brown fox", "über die Straße", "a b c d e f", "x x x x x x x x", "semi;colon", "tab\tword two"]
    for i in range(160):
        parts = []
        for _ in range(draw.randint(0, 25)):
            parts.append(draw.choice(common) if draw.random() < 0.4 else draw.choice(["a", "b", "É", "c", "Dd", "éé", "z"]))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b"]))
        docs.append((i, "".join(parts), ["en", "en", "de", None][i % 4], i, "x"))
    docs += [(1, None, "en", 0, None), (2, "", None, 0, None), (None, " \t.;\n", "xx", 0, None), (None, docs[0][1], "en", 0, None)]
    docs += [(500, "long word " * 4000 + "the end", "und", 0, None), (501, "und one und", "und", 0, None)]
    return docs


@pytest.mark.parametrize("support,covered,limit,block", [(5, 100, 2000, 1 << 21), (3, 80, 7, 50), (12, 100, 2000, 1)])
def test_as_counted_one_by_one(spark, monkeypatch, support, covered, limit, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    docs = documents()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    found = collocations.collocations(frame, support=support, covered=covered, limit=limit)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(docs, support, covered, limit)


def test_nothing_to_find(spark):
    frame = spark.createDataFrame([(1, "a b c", None, 0, None), (2, None, None, 0, None)], SCHEMA)
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "_LONG_TEXT", 10)
    text = b"one two three four. five six, seven eight nine ten eleven twelve"
    parts = list(collocations._pieces(text))
    assert b"".join(parts) == text and parts[:2] == [b"one two three four.", b" five six, seven eight nine ten eleven twelve"][:2]
    assert all(p.endswith((b".", b",")) for p in parts[:-1])
