from __future__ import annotations

import random
import re
from collections import Counter

from stockledger.llm import rules


def plain(text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines, covered = set(), 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, lines, len(covered)


def test_counts_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(rules, "LEAST", 20)
    draw, docs = random.Random(3), []
    for i in range(150):
        words = ["".join(draw.choice("abcdéß") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(60, 120))]
        lang, source = ("en", "big") if i < 100 else ("de", None) if i < 140 else (None, "tiny")
        docs.append((i, " ".join(words), lang, source))
    symbols = " ".join(["ab|", "c#d", "e$f", "g%%h"] * 3 + [f"w{i}" for i in range(80)])
    docs += [(200, symbols, "en", "big"), (201, "same line of words\n" * 30, "en", "big"), (202, None, "en", "big")]
    docs += [(203, "", None, None), (204, "few words", "de", None), (205, " \n\x0b\t\n", "xx", "new"), (None, docs[0][1], "en", "big")]
    docs += [docs[0], (206, " ".join(f"{'long' * 12}{i}" for i in range(70)), "en", "big")]
    frame = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, lang string, source string, kept boolean")
    found = {r.doc_id: r for r in rules.judged(frame.repartition(3)).collect()}
    for doc_id, text, _, _ in docs:
        r = found[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)
    assert all(found[i].kept for i in range(150)) and found[None].kept
    assert not any(found[i].kept for i in (200, 201, 202, 203, 204, 205, 206))
    kept = rules.filtered(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(150))
    # Too few texts of its own: a group uses its language's thresholds, or all texts'.
    bounds = {(r.lang, r.source): r.n_texts for r in rules.thresholds(rules.measures(rules.text_counts(frame))).collect()}
    assert bounds["en", "big"] == 104 and bounds["de", None] == 40 and bounds[None, "tiny"] == bounds["xx", "new"] == 154
    assert rules.judged(frame.limit(0)).count() == 0
