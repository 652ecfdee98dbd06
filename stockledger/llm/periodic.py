"""Periodic runs of words: stretches that repeat themselves at once, found as maximal pairs of an LCP-interval tree.

Words are ``[^\\x20\\x09-\\x0D]+``. Two places of a text are a maximal pair if as many words agree behind both as the pair's length says, and neither
the next words nor the words in front of them do. A stretch [s, e) has period q and cannot be extended keeping it if and only if
(s, s+q) is a maximal pair of length e-s-q. So the runs are read off the maximal pairs whose distance is at
most their length, and nothing is extended.

For a batch of texts the places of which the next six words come again in the same text are put in suffix order by doubling, in numpy; a run of twelve words or more
has at least that many in common with itself one period on, so the others cannot matter. The common lengths of neighbours in that order
are found from the numbers of the doubled windows. Their interval tree is walked bottom-up: a node holds its places, and those of them
whose left word differs from the place's before, as sets of bits in words of 64; a smaller set is merged into a larger one, and for each of its places
the other set is read only within the node's length and, where left words agree, skipped to the next change. So the work grows
with the runs found, not with the pairs of equal words. A pair whose distance is a multiple of the
run's period is found too and gives way to the least period of its stretch.

Null and empty texts have no words and no runs. Every row is judged by itself: ids may be null or repeated. A text is one task's work, whatever its
length. Columns of the input are kept apart from results by name: only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import id_and_text, record, runs
from stockledger.llm.textstats import TextRun

LEAST_LENGTH = 12
BITS = 6

RUN_FIELDS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN_FIELDS)), ("collapsed", pa.binary())])


class Places:
    """A set of places from 1 on as bits, with the next and the previous member of any place in a few steps whatever the set's size.

    Each layer has a bit for every word of the layer below that is not zero.
    """

    __slots__ = ("layers",)

    def __init__(self, depth: int):
        self.layers = [{} for _ in range(depth)]

    def add(self, place: int) -> None:
        for layer in self.layers:
            word, bit = place >> BITS, 1 << (place & 63)
            old = layer.get(word, 0)
            layer[word] = old | bit
            if old:
                return
            place = word

    def discard(self, place: int) -> None:
        for layer in self.layers:
            word = place >> BITS
            left = layer.get(word, 0) & ~(1 << (place & 63))
            if left:
                layer[word] = left
                return
            if layer.pop(word, None) is None:
                return
            place = word

    def after(self, place: int) -> int:
        """Least member above ``place``, or -1."""
        layers = self.layers
        for depth, layer in enumerate(layers):
            above = layer.get(place >> BITS, 0) >> (place & 63) >> 1
            if above:
                place += (above & -above).bit_length()
                for low in range(depth - 1, -1, -1):
                    word = layers[low][place]
                    place = place << BITS | (word & -word).bit_length() - 1
                return place
            place >>= BITS
        return -1

    def before(self, place: int) -> int:
        """Greatest member below ``place``, or -1."""
        layers = self.layers
        for depth, layer in enumerate(layers):
            below = layer.get(place >> BITS, 0) & ((1 << (place & 63)) - 1)
            if below:
                place = place >> BITS << BITS | below.bit_length() - 1
                for low in range(depth - 1, -1, -1):
                    place = place << BITS | layers[low][place].bit_length() - 1
                return place
            place >>= BITS
        return -1


class Leaves:
    """The places below a node of the tree, and those whose left word differs from the one of the place before."""

    __slots__ = ("first", "places", "changes", "size")

    def __init__(self, place: int):
        self.first, self.places, self.changes, self.size = place, None, None, 1

    def grow(self, depth: int) -> None:
        if self.places is None:
            self.places, self.changes = Places(depth), Places(depth)
            self.places.add(self.first)
            self.changes.add(self.first)

    def insert(self, place: int, left) -> None:
        places, changes = self.places, self.changes
        before, after = places.before(place), places.after(place)
        if before < 0 or left[before] != left[place]:
            changes.add(place)
        if after >= 0:
            if left[after] != left[place]:
                changes.add(after)
            else:
                changes.discard(after)
        places.add(place)
        self.size += 1

    def members(self) -> Iterator[int]:
        if self.places is None:
            yield self.first
            return
        place = self.places.after(0)
        while place >= 0:
            yield place
            place = self.places.after(place)

    def partners(self, place: int, reach: int, left) -> Iterator[int]:
        """Members at most ``reach`` from ``place`` whose left word is another one, in order."""
        if self.places is None:
            if abs(self.first - place) <= reach and left[self.first] != left[place]:
                yield self.first
            return
        own, last, at = left[place], place + reach, place - reach - 1
        at = self.places.after(max(at, 0))
        while 0 <= at <= last:
            if left[at] == own:
                # Up to the next change all have this left word; there it differs.
                at = self.changes.after(at)
            else:
                yield at
                at = self.places.after(at)


def _joined(leaves: Leaves, child: Leaves, length: int, left, depth: int, least: int, found: list) -> Leaves:
    """Both sets as one; the maximal pairs between them go to ``found`` as (start, period, end)."""
    small, large = (leaves, child) if leaves.size < child.size else (child, leaves)
    for place in small.members():
        for other in large.partners(place, length, left):
            start, period = (place, other - place) if place < other else (other, place - other)
            if period + length >= least:
                found.append((start, period, start + period + length))
    large.grow(depth)
    for place in small.members():
        large.insert(place, left)
    return large


def tree_pairs(order: list[int], common: list[int], left, depth: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal pairs of places in suffix order, at most their common length apart; ``common[i]`` is that of ``order[i - 1]`` and ``order[i]``."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, Leaves]] = []
    for place, length in zip(order, [*common[1:], 0]):
        last = Leaves(place)
        while stack and stack[-1][0] > length:
            here, leaves = stack.pop()
            last = _joined(leaves, last, here, left, depth, least, found)
        if stack and stack[-1][0] == length:
            last = _joined(stack.pop()[1], last, length, left, depth, least, found)
        if length:
            stack.append((length, last))
    return found


class SuffixOrder:
    """Places of a batch of texts whose next ``seed`` words come again in the text, in suffix order, with their common lengths.

    ``words`` holds a 0, then word numbers from 1 with a 0 behind each text; ``text`` the number of the text of each. A number stands for a
    window of words: the place of its first member in the order of all windows. Windows that occur once keep their number from
    then on, so each step sorts only what is still undecided.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, seed: int):
        n = len(words)
        key = text * (int(words.max(initial=0)) + 1) + words
        self.rank = np.zeros(n, dtype=np.int64)
        self.open = np.arange(n)
        self._number(key, np.zeros(n, dtype=np.int64))
        self.levels = [(1, self.rank.astype(np.int32))]
        width = 1
        while width < seed and len(self.open):
            step = min(width, seed - width)
            self._refine(step, width + step)
            width += step
        members = self.open
        while len(self.open):
            self._refine(width, 2 * width)
            width *= 2
        self.order = members[np.argsort(self.rank[members])]
        self.common = self._common(seed)

    def _number(self, key: np.ndarray, base: np.ndarray) -> None:
        """Number the open places by ``key``; ``base`` is the number their group has had, rising with the key."""
        by_key = np.argsort(key, kind="stable")
        key, base, places = key[by_key], base[by_key], self.open[by_key]
        at = np.arange(len(key))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(key), dtype=bool)
        group[1:] = base[1:] != base[:-1]
        first = np.maximum.accumulate(np.where(new, at, 0))
        self.rank[places] = base + first - np.maximum.accumulate(np.where(group, at, 0))
        again = ~new
        again[:-1] |= ~new[1:]
        self.open = places[again]

    def _refine(self, step: int, width: int) -> None:
        n = len(self.rank)
        ahead = self.open + step
        behind = np.where(ahead < n, self.rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = self.rank[self.open]
        self._number(base * (n + 1) + behind, base)
        self.levels.append((width, self.rank.astype(np.int32)))

    def _common(self, seed: int) -> np.ndarray:
        """Words that each place has in common with the one before it in the order; 0 if fewer than ``seed``."""
        common = np.zeros(len(self.order), dtype=np.int64)
        if len(common) > 1:
            a, b = self.order[:-1], self.order[1:]
            length, end = np.zeros(len(a), dtype=np.int64), len(self.rank) - 1
            for width, rank in reversed(self.levels):
                same = rank[np.minimum(a + length, end)] == rank[np.minimum(b + length, end)]
                length += width * same
            common[1:] = np.where(length >= seed, length, 0)
        return common


def found_runs(words_at: np.ndarray, ids: np.ndarray, least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start and period; ``ids`` are word numbers, text i has those from ``words_at[i]`` on."""
    n_texts, n_words = len(words_at) - 1, np.diff(words_at)
    text = np.concatenate([[n_texts], np.repeat(np.arange(n_texts), n_words + 1)])
    words = np.zeros(len(text), dtype=np.int64)
    starts = 1 + words_at[:-1] + np.arange(n_texts)
    inside = 1 + np.arange(len(ids)) + np.repeat(np.arange(n_texts), n_words)
    words[inside] = ids + 1
    # A run of ``least`` words repeats at least that many words less a period, of which it has two or more.
    suffixes = SuffixOrder(words, text, max(1, -(-least // 2)))
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(n_texts)]
    if len(suffixes.order):
        left = np.concatenate([[0], words[:-1]]).tolist()
        depth = max(1, -(-len(words).bit_length() // BITS))
        for start, period, end in tree_pairs(suffixes.order.tolist(), suffixes.common.tolist(), left, depth, least):
            own = found[text[start]]
            own[start, end] = min(period, own.get((start, end), period))
    return [
        sorted((start - int(at), end - start, period) for (start, end), period in own.items())
        for own, at in zip(found, starts)
    ]


def without_repeats(words: list[bytes], runs_of_text: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run the first period only."""
    if runs_of_text:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs_of_text:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist()) if not dropped]
    return b" ".join(words)


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """A row for each row of ``docs``: its id, n_words, runs (an array of start, length and period, by start) and the collapsed text.

    A run is a longest stretch of at least ``least_length`` words that holds its least period twice or more. The collapsed text has
    only the first period of each run, its words joined by one space.
    """

    def run(batches):
        for ids, texts in runs(batches):
            batch = TextRun(texts)
            found = found_runs(batch.words_at, batch.ids, least_length)
            collapsed = [without_repeats(t.split(), r) for t, r in zip(texts, found)]
            as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            yield record(FOUND, ids, batch.n_words(), as_rows, collapsed)

    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    found = id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_table(docs: DataFrame, **how) -> DataFrame:
    """A row for each run: id, start, length, period."""
    return periodic(docs, **how).select("id", F.inline("runs"))
