"""Counts over runs of whole texts, in numpy. Words are ``[^\\x20\\x09-\\x0D]+``; sizes are code points."""

from __future__ import annotations

import numpy as np

from stockledger.llm.common import Ids, offsets_of

SYMBOLS = b"#*$%&|<>"
_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
IS_START = (_BYTES & 0xC0) != 0x80  # the first byte of a code point
IS_SYMBOL = np.isin(_BYTES, list(SYMBOLS))


class TextRun:
    """A run of texts as one array of bytes and one of word numbers, with the offsets of both by text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.at = offsets_of([len(t) for t in texts])
        numbers = Ids()
        words = [t.split() for t in texts]
        self.words_at = offsets_of([len(w) for w in words])
        self.ids = np.fromiter((numbers[w] for ws in words for w in ws), dtype=np.int64, count=self.words_at[-1])
        self.vocabulary = list(numbers)

    def total(self, of_byte: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each text of a value looked up by byte."""
        return self.sums(of_byte.astype(np.uint8)[self.bytes], self.at)

    @staticmethod
    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])

    def n_words(self) -> np.ndarray:
        return np.diff(self.words_at)

    def word_chars(self) -> np.ndarray:
        return self.total(IS_START & ~IS_SPACE)

    def distinct_words(self) -> np.ndarray:
        text = np.repeat(np.arange(len(self.texts)), self.n_words())
        seen = np.unique(text * max(1, len(self.vocabulary)) + self.ids)
        return np.bincount(seen // max(1, len(self.vocabulary)), minlength=len(self.texts))

    def duplicate_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line of the text."""
        lines, duplicates = [], []
        for text in self.texts:
            own = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines.append(len(own))
            duplicates.append(len(own) - len(set(own)))
        return np.asarray(lines), np.asarray(duplicates)

    def repeated_words(self, window: int = 3) -> np.ndarray:
        """Words in windows of ``window`` words found twice or more in the text, the first time included."""
        n, total = self.n_words(), len(self.ids)
        text = np.repeat(np.arange(len(n)), n)
        size = max(0, total - window + 1)
        inside = text[:size] == text[window - 1 :] if size else np.zeros(0, dtype=bool)
        # Number the windows exactly, one word more at a time: equal numbers, equal windows of the same text.
        numbers = text[:size]
        for k in range(window):
            joined = numbers * max(1, len(self.vocabulary)) + self.ids[k : k + size]
            if k + 1 < window and (joined.max(initial=0) + 1) * max(1, len(self.vocabulary)) < 1 << 62:
                numbers = joined
            else:
                numbers = np.unique(joined, return_inverse=True)[1]
        often = inside & (np.bincount(numbers[inside], minlength=size + 1) > 1)[numbers] if size else inside
        covered = np.zeros(total, dtype=bool)
        for k in range(window):
            covered[k : k + size] |= often
        return self.sums(covered, self.words_at)
