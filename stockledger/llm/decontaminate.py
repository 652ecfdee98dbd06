"""Benchmark decontamination by suffix arrays of the training texts.

Texts are cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Every task makes suffix arrays
of runs of whole documents (shards): the suffixes, by their words, in order. Every suffix of the benchmark's
items is searched in every shard by bisection, which gives all places of its first ``window`` words; places
that go on along both texts join into longest verbatim matches.

A suffix of a document of which the first three words follow each other nowhere in the benchmark cannot be found, and is
left out of the array. The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES``;
each block is searched in all documents, and a document's findings are joined afterwards.

An item of fewer words than ``window``, but not none, is searched as a whole. Nulls and empty texts have no words: such
a document has no hits and such an item is found nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import Ids, id_and_text, offsets_of, record, runs, text_runs, written

WINDOW = 10
BLOCK_BYTES = 8 << 20

# Letters A-Z to a-z; digits, a-z and bytes of other scripts as they are; all else ends a word.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.int32())),
        ("items", pa.list_(pa.int64())),
    ]
)
MATCHES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("doc_from", pa.int64()),
        ("item_from", pa.int64()),
        ("n_words", pa.int64()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Suffixes:
    """The benchmark's windows, made ready for search in any shard."""

    GRAM_BITS = 22

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.words = Ids(1)  # 0 stands for words that no item has, and ends a document
        self.items: list[int] = []
        places: dict[int, list[tuple[int, int]]] = {}
        numbers: dict[int, list[list[int]]] = {}
        for item_id, text in items:
            ids = [self.words[w] for w in words_of(text)]
            if not ids:
                continue
            length, number = min(window, len(ids)), len(self.items)
            self.items.append(item_id)
            for at in range(len(ids) - length + 1):
                numbers.setdefault(length, []).append(ids[at : at + length])
                places.setdefault(length, []).append((number, at))
        # For each length: the distinct windows as sortable bytes, where each occurs, and the grams they begin with.
        self.by_length = []
        for length, rows in numbers.items():
            keys = self._keys(np.asarray(rows, dtype=">u4"))
            distinct, inverse = np.unique(keys, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            gram = min(3, length)
            begins = np.zeros(1 << self.GRAM_BITS, dtype=bool)
            begins[self._gram(np.asarray(rows, dtype=np.int64), gram)] = True
            self.by_length.append(
                (length, gram, begins, distinct, offsets_of(np.bincount(inverse, minlength=len(distinct))),
                 np.asarray(places[length], dtype=np.int64)[order])
            )
        self.words = dict(self.words)

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()

    def _gram(self, columns: np.ndarray, gram: int) -> np.ndarray:
        """Bucket of the first ``gram`` words of each row."""
        out = np.zeros(len(columns), dtype=np.int64)
        for k in range(gram):
            out = out * 1_000_003 + columns[:, k]
        return (out ^ (out >> self.GRAM_BITS)) & ((1 << self.GRAM_BITS) - 1)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places in the shard, windows found there), by bisection in the shard's suffix array."""
        for length, gram, begins, distinct, ends, places in self.by_length:
            if len(ids) < length:
                continue
            views = np.lib.stride_tricks.sliding_window_view(ids, gram)[: len(ids) - length + 1]
            at = np.flatnonzero(begins[self._gram(views, gram)] & (ids[: len(views)] > 0))
            keys = self._keys(ids[at[:, None] + np.arange(length)].astype(">u4"))
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            low, high = np.searchsorted(keys, distinct, "left"), np.searchsorted(keys, distinct, "right")
            counts = high - low
            found = np.flatnonzero(counts)
            window = np.repeat(found, counts[found])
            within = np.arange(len(window)) - np.repeat(np.cumsum(counts[found]) - counts[found], counts[found])
            yield length, at[low[window] + within], window

    def places(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by window, (item, place) rows) of the windows of a length."""
        return next((ends, places) for n, _, _, _, ends, places in self.by_length if n == length)


def _shard(suffixes: Suffixes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a run of documents, each ended by 0, and where each document begins."""
    get, parts, lengths = suffixes.words.get, [], []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int64))
        lengths.append(len(words) + 1)
    return np.concatenate(parts), offsets_of(lengths)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in blocks of at most ``BLOCK_BYTES`` of text (a longer item: a block of its own)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull())
    block, size = [], 0
    for row in items.toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.id, text))
        size += len(text)
    yield block


def _find(docs: DataFrame, items: list[tuple[int, bytes]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        suffixes = Suffixes(shared.value, window)
        item_ids = suffixes.items
        for ids, texts in runs(batches):
            words, begins = _shard(suffixes, texts)
            hit, pairs = np.zeros(len(words) + 1, dtype=np.int64), []
            for length, at, windows in suffixes.search(words):
                np.add.at(hit, at, 1)
                np.add.at(hit, at + length, -1)
                ends, places = suffixes.places(length)
                here = np.searchsorted(begins, at, "right") - 1
                seen = np.unique(here * len(ends) + windows)
                for doc, w in zip(seen // len(ends), seen % len(ends), strict=True):
                    pairs.append((doc, np.unique(places[ends[w] : ends[w + 1], 0])))
            covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            cut = np.searchsorted(covered, begins)
            by_doc: dict[int, set[int]] = {}
            for doc, numbers in pairs:
                by_doc.setdefault(doc, set()).update(numbers.tolist())
            rows = [
                (
                    ids[d],
                    int(begins[d + 1] - begins[d] - 1),
                    (covered[cut[d] : cut[d + 1]] - begins[d]).astype(np.int32),
                    sorted({item_ids[i] for i in by_doc.get(d, ())}, key=lambda x: (x is None, x)),
                )
                for d in range(len(ids))
            ]
            yield record(FOUND, *map(list, zip(*rows, strict=True)))

    return docs.mapInArrow(run, "doc_id long, n_words long, hits array<int>, items array<long>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, hits, items): places of hit words and the different ids of the items found, a row for each row of ``docs``.

    With a benchmark of one block this is one pass without a shuffle. With more, rows are numbered in a written copy and the
    findings of the blocks joined by that number; the rows are the same. Items without an id count as one item.
    """
    texts = id_and_text(docs, id_col, text_col)
    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _find(texts, first, window)
    numbered = written(texts.withColumn("number", F.monotonically_increasing_id()), "texts", compression="zstd")
    rows = numbered.select("number", "text")
    found = _find(rows, first, window)
    for block in chain([second], blocks):
        found = found.unionByName(_find(rows, block, window).where(F.size("items") > 0))
    found = found.groupBy(F.col("doc_id").alias("number")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    ids = numbered.select(F.col("id").alias("doc_id"), "number")
    return ids.join(found, "number").drop("number")


def report(found: DataFrame) -> DataFrame:
    """One row for each document: counts, the items as a digest of their sorted ids, and the verdict."""
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Longest verbatim matches of at least a window: (doc_id, item_id, doc_from, item_from, n_words), in words.

    A match cannot be made longer at either end; equal passages at several places give a row for each pair of places.
    """
    texts, found = id_and_text(docs, id_col, text_col), None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            suffixes = Suffixes(shared.value, window)
            for ids, texts_ in runs(batches):
                words, begins = _shard(suffixes, texts_)
                for length, at, windows in suffixes.search(words):
                    ends, places = suffixes.places(length)
                    n = (ends[1:] - ends[:-1])[windows]
                    row = np.repeat(np.arange(len(at)), n)
                    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    item, start = places[ends[windows[row]] + within].T
                    # Windows of one match lie on one diagonal, one word apart.
                    order = np.lexsort((at[row], at[row] - start, item))
                    item, start, place = item[order], start[order], at[row][order]
                    new = np.ones(len(item), dtype=bool)
                    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1)
                    first = np.flatnonzero(new)
                    size = np.diff(np.append(first, len(item))) + length - 1
                    doc = np.searchsorted(begins, place[first], "right") - 1
                    yield record(
                        MATCHES, [ids[d] for d in doc], [suffixes.items[i] for i in item[first]],
                        place[first] - begins[doc], start[first], size,
                    )

        part = texts.mapInArrow(run, "doc_id long, item_id long, doc_from long, item_from long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns, without a hit. Every row is judged by its own text, block by block of the benchmark."""
    for block in _blocks(benchmark, item_col, item_text_col):
        docs = docs.where(~_hit(docs.sparkSession.sparkContext.broadcast(block), window)(F.col(text_col).cast("string")))
    return docs


def _hit(shared, window: int):
    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        suffixes = Suffixes(shared.value, window)
        for column in texts:
            out = []
            for part in text_runs(column):
                words, begins = _shard(suffixes, part)
                found = np.zeros(len(part), dtype=bool)
                for _, at, _ in suffixes.search(words):
                    found[np.searchsorted(begins, at, "right") - 1] = True
                out += found.tolist()
            yield pa.array(out, pa.bool_())

    return hit
