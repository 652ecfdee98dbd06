"""Exact dedup of repeated byte strings: a suffix sort by hashes, met at anchors.

Every string of ``SPAN`` bytes that starts anywhere else too is covered, and covered bytes are removed. To bring equal strings together,
each string has an anchor: the place in it at which its 32-byte grams have their lowest hash. Equal strings have equal anchors
at the same place, and strings that follow each other mostly share theirs, so a text falls into segments: the bytes of
neighbouring strings of one anchor. Segments are known by their anchor's hash and their own digest.

Segments found twice are covered as they are, and stand for one from then on. Different segments with equal anchors are compared: an
anchor's left and right contexts are suffixes (the left ones read backwards), sorted by merging. Two suffixes
are compared by their longest common extension, found by bisection on polynomial prefix hashes, and the extension's
bytes are then compared themselves. For each width o to the left of the anchor, texts that agree on o bytes before it and SPAN - o from
it on are neighbours in both orders, so the lengths that neighbours have in common tell which strings repeat.

An anchor with more than ``CROWD`` different segments is split. All are compared with one of them, the centre: a string that the
centre lacks reaches further to one side than the segment's extension with the centre does, so it can only be shared with segments that part
from the centre at the same place with the same byte. Those make new, smaller groups, one for each side.

Texts are UTF-8 bytes; null texts are empty. Matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.chunks import without
from stockledger.llm.common import id_and_text, mixed, offsets_of, record, runs, written

SPAN = 400
GRAM = 32
CROWD = 400
_BLOCK = 1 << 22  # strings of a text taken at a time, so that a place fits in 24 bits
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEGMENTS = pa.schema(
    [("row", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64())]
)
PARTS = pa.schema([("part", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])
COVERED = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
KEPT = pa.schema(
    [("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def grams_of(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes that begin at each place."""
    h, base, width = _BYTE[data], int(_BASE), 1
    while width < size:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    return mixed(h)


def segments_of(text: bytes, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(start, size, place of the anchor, hash of the anchor) of each segment; a text shorter than ``span`` has none."""
    found = []
    for begin in range(0, len(text) - span + 1, _BLOCK):
        data = np.frombuffer(text, dtype=np.uint8, offset=begin, count=min(len(text) - begin, _BLOCK + span - 1))
        grams = grams_of(data)
        least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, target = 1, span - GRAM + 1
        while 2 * width <= target:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < target:
            least = np.minimum(least[: len(least) - (target - width)], least[target - width :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(first, len(at))) + span - 1
        found.append((first + begin, size, at[first] + begin, grams[at[first]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digests(text: bytes, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digest of each segment, with its anchor's place in it."""
    return np.asarray(
        [xxhash.xxh3_64_intdigest(text[s : s + n], seed=p - s) for s, n, p in zip(start.tolist(), size.tolist(), at.tolist(), strict=True)],
        dtype=np.uint64,
    ).view(np.int64)


class Suffixes:
    """Many byte strings, compared by prefix hashes: each string is a suffix to be sorted in its group."""

    def __init__(self, strings: list[bytes], groups: np.ndarray):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.at = offsets_of([len(s) for s in strings])
        self.size = np.diff(self.at)
        self.groups = groups
        power = np.cumprod(np.full(len(self.data), _BASE, dtype=np.uint64))
        # Prefix hash modulo 2**64 of odd random byte values; powers of an odd base can be undone.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * power)])
        self.undo = np.cumprod(np.full(len(self.data) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))

    def _hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin = self.at[i]
        return (self.sums[begin + n] - self.sums[begin]) * self.undo[begin]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of pairs of strings, its bytes verified."""
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self._hash(i, middle) == self._hash(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        # Collision verification: the bytes themselves; where they differ, they differ from there on.
        step = np.repeat(np.arange(len(i)), low)
        within = np.arange(len(step)) - np.repeat(np.cumsum(low) - low, low)
        wrong = np.flatnonzero(self.data[self.at[i[step]] + within] != self.data[self.at[j[step]] + within])
        np.minimum.at(low, step[wrong], within[wrong])
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i comes before string j: by group, then bytes, then number."""
        out = self.groups[i] < self.groups[j]
        same = np.flatnonzero(self.groups[i] == self.groups[j])
        x, y = i[same], j[same]
        n = self.common(x, y)
        ended = (n == self.size[x]) | (n == self.size[y])
        a, b = (self.data[np.minimum(self.at[v] + n, len(self.data) - 1)] for v in (x, y))
        shorter = (self.size[x] < self.size[y]) | ((self.size[x] == self.size[y]) & (x < y))
        out[same] = np.where(ended, shorter, a < b)
        return out

    def order(self) -> np.ndarray:
        """Mergesort: runs of doubling length; each string's place is its own plus its rank in the run beside it."""
        n = len(self.size)
        order, width = np.argsort(self.groups, kind="stable"), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                less = self.before(order[middle], order[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            target = (run & ~1) * width + place % width + (low - begin)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common length of each string in order with the one before it; 0 where a group begins."""
        out = np.zeros(len(order), dtype=np.int64)
        same = np.flatnonzero(self.groups[order[1:]] == self.groups[order[:-1]]) + 1
        out[same] = self.common(order[same], order[same - 1])
        return out


def covered(strings: list[bytes], left: np.ndarray, groups: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the bytes of each segment in strings that another segment of its group has too; equal where none.

    ``left`` is the anchor's place in each segment. All strings hold their anchor, so covered ones overlap.
    """
    n = len(strings)
    low, high = np.full(n, np.iinfo(np.int32).max), np.zeros(n, dtype=np.int64)
    classes = []
    right = Suffixes([s[a:] for s, a in zip(strings, left.tolist(), strict=True)], groups)
    back = Suffixes([s[:a][::-1] for s, a in zip(strings, left.tolist(), strict=True)], groups)
    for side in (right, back):
        order = side.order()
        classes.append((order, side.neighbours(order)))
    (right_order, right_common), (back_order, back_common) = classes
    starts = [np.concatenate([[True], groups[o][1:] != groups[o][:-1]]) for o in (right_order, back_order)]

    def numbers(order: np.ndarray, common: np.ndarray, least: int, start: np.ndarray) -> np.ndarray:
        # Strings of a group that agree on ``least`` bytes have the same number.
        new = (common < least) | start
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(new)
        return out

    for o in range(int(left.max(initial=0)) + 1):
        able = np.flatnonzero((left >= o) & (right.size >= span - o))
        if not len(able):
            continue
        key = numbers(back_order, back_common, o, starts[1])[able] * (n + 1)
        key += numbers(right_order, right_common, span - o, starts[0])[able]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = able[count[inverse] > 1]
        low[twice] = np.minimum(low[twice], left[twice] - o)
        high[twice] = np.maximum(high[twice], left[twice] - o + span)
    return np.minimum(low, high), high


def segment_rows(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, start, size, anchor, digest) of all segments of all rows."""

    def run(batches):
        for ids, part in runs(batches):
            columns = [[] for _ in SEGMENTS]
            for row, text in zip(ids, part, strict=True):
                start, size, at, anchor = segments_of(text, span)
                for column, values in zip(columns, (np.full(len(start), row), start, size, anchor, _digests(text, start, size, at)), strict=True):
                    column.append(values)
            yield record(SEGMENTS, *(np.concatenate(c) for c in columns))

    return texts.mapInArrow(run, "row long, start long, size int, anchor long, digest long")


def segment_bytes(texts: DataFrame, wanted: DataFrame, span: int = SPAN) -> DataFrame:
    """(part, anchor, digest, left, bytes) of the segments (row, start, size, anchor, digest) in ``wanted``."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text.encode()
                for x in segments:
                    piece = text[x["start"] : x["start"] + x["size"]]
                    grams = grams_of(np.frombuffer(piece, dtype=np.uint8))
                    # The anchor is the gram that all strings of the segment hold and that is lowest there.
                    low, high = x["size"] - span, span - GRAM
                    least = grams[low : high + 1] & ~np.uint64((1 << 24) - 1)
                    rows.append((x["anchor"], x["anchor"], x["digest"], low + int(least.argmin()), piece))
            yield record(PARTS, *map(list, zip(*rows, strict=True))) if rows else record(PARTS, [], [], [], [], [])

    by_row = wanted.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("start", "size", "anchor", "digest")).alias("segments"))
    given = texts.join(by_row, F.col("id") == F.col("of")).select("text", "segments")
    return given.mapInArrow(run, "part long, anchor long, digest long, left int, bytes binary")


def compared(parts: DataFrame, span: int = SPAN, batch_bytes: int = 4 << 20) -> DataFrame:
    """(anchor, digest, low, high): what the segments of each part cover of each other; parts are met in sorted order."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        part, anchor, digest, left, strings = zip(*rows, strict=True)
        low, high = covered(list(strings), np.asarray(left, dtype=np.int64), np.asarray(part, dtype=np.int64), span)
        found = np.flatnonzero(high > low)
        return record(COVERED, np.asarray(anchor)[found], np.asarray(digest)[found], low[found], high[found])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > batch_bytes and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield done(rows)

    dealt = parts.select(*PARTS.names).repartition(F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "anchor long, digest long, low int, high int")


def split(crowds: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """What the segments of crowded parts cover together with their centre, and the smaller parts they fall into."""
    both = pa.schema([*PARTS, ("low", pa.int32()), ("high", pa.int32()), ("centre_low", pa.int32()), ("centre_high", pa.int32()), ("centre", pa.int64())])

    def run(batches):
        for batch in batches:
            part, anchor, digest, left, strings, centre, centre_left, centre_bytes = (c.to_pylist() for c in batch.columns)
            out = []
            for row in zip(part, anchor, digest, left, strings, centre, centre_left, centre_bytes, strict=True):
                p, h, d, a, s, c, ca, cs = row
                if d == c:
                    continue
                left_both, right_both = _common(s[:a][::-1], cs[:ca][::-1]), _common(s[a:], cs[ca:])
                found = left_both + right_both >= span
                spans = (a - left_both, a + right_both, ca - left_both, ca + right_both) if found else (0, 0, 0, 0)
                for side, n, rest in ((1, left_both, s[:a][::-1]), (2, right_both, s[a:])):
                    known = p if n == len(rest) else xxhash.xxh3_64_intdigest(rest[: n + 1], seed=(p * 4 + side) % (1 << 63))
                    out.append((None if n == len(rest) else known - (1 << 64) * (known >= 1 << 63), h, d, a, s, *spans, c))
                    spans = (0, 0, 0, 0)
            yield record(both, *map(list, zip(*out, strict=True))) if out else record(both, *[[]] * len(both))

    centres = crowds.groupBy("part").agg(F.min("digest").alias("centre"))
    centre = crowds.join(centres.withColumnRenamed("part", "of"), (F.col("part") == F.col("of")) & (F.col("digest") == F.col("centre")))
    centre = written(centre.select("of", "centre", F.col("left").alias("centre_left"), F.col("bytes").alias("centre_bytes")), "centres")
    given = crowds.join(centre, F.col("part") == F.col("of")).select(*PARTS.names, "centre", "centre_left", "centre_bytes")
    names = "part long, anchor long, digest long, left int, bytes binary, low int, high int, centre_low int, centre_high int, centre long"
    found = written(given.mapInArrow(run, names), "split")
    shared = found.where("high > low")
    cover = shared.select("anchor", "digest", "low", "high").unionByName(
        shared.groupBy("anchor", F.col("centre").alias("digest")).agg(F.min("centre_low").alias("low"), F.max("centre_high").alias("high"))
    )
    return cover, found.where(F.col("part").isNotNull()).select(*PARTS.names)


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int(np.argmax(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)))


def covered_segments(texts: DataFrame, segments: DataFrame, span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """(anchor, digest, low, high): the bytes of each segment that are covered, low and high within it."""
    kinds = segments.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min(F.struct("row", "start")).alias("at")
    )
    kinds = written(kinds, "kinds")
    whole = kinds.where("n > 1").select("anchor", "digest", F.lit(0).alias("low"), F.col("size").alias("high"))
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").withColumnRenamed("anchor", "of")
    wanted = kinds.join(many, F.col("anchor") == F.col("of")).select("at.row", "at.start", "size", "anchor", "digest")
    parts = written(segment_bytes(texts, wanted, span), "parts")
    found = [whole]
    while True:
        counts = written(parts.groupBy("part").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("part", "of"), "counts")
        sized = parts.join(counts, F.col("part") == F.col("of"))
        found.append(written(compared(sized.where(F.col("k").between(2, crowd)), span), "covered"))
        if counts.where(F.col("k") > crowd).isEmpty():
            break
        cover, parts = split(sized.where(F.col("k") > crowd).select(*PARTS.names), span)
        found.append(cover)
        parts = written(parts, "parts")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.groupBy("anchor", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def deduplicated(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``.

    ``kept`` is the bytes that are left; cut ends may fall within a character. Every row is a text of its own, whether its id is unique,
    repeated or null: rows are numbered in a written copy of ids and texts, and known by that number.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for ids, part in runs(iter([batch])):
                rows = []
                for row, text, spans in zip(ids, part, batch.column(2).slice(at, len(ids)).to_pylist(), strict=True):
                    joined: list[list[int]] = []
                    for x in sorted((x["low"], x["high"]) for x in spans or ()):
                        if joined and x[0] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], x[1])
                        else:
                            joined.append(list(x))
                    kept = without(text, joined)
                    rows.append((row, kept, len(text), len(text) - len(kept), len(joined), hashlib.sha256(kept).hexdigest()))
                yield record(KEPT, *map(list, zip(*rows, strict=True)))
                at += len(ids)

    numbered = id_and_text(docs, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    numbered = written(numbered, "texts", compression="zstd")
    texts = numbered.select(F.col("number").alias("id"), "text")
    segments = written(segment_rows(texts, span), "segments")
    cover = covered_segments(texts, segments, span)
    spans = segments.join(cover, ["anchor", "digest"]).groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("spans")
    )
    given = numbered.join(written(spans, "spans"), F.col("number") == F.col("of"), "left").select("id", "text", "spans")
    return given.mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
