"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: every byte shifts the hash one bit and adds a fixed random number, so the hash depends on
the last 16 bytes. A chunk ends where the hash's upper bits are 0, unless another such place lies less than ``LEAST`` bytes before, and
after ``MOST`` bytes at the latest; never within a character. The rule looks at nearby bytes only, so an insertion moves the
ends around it and no others. Chunks are known by a 128-bit digest.

A chunk repeats if a document with a smaller id, or an earlier place of the same document, has it. Repeated chunks are removed where they
stand in a row for at least ``RUN`` bytes; the first holder of a chunk always keeps it. Null and empty texts have no chunks.
Rows that share an id are one document; a row without an id is compared with itself only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import fresh, id_and_text, record, runs, written
from stockledger.llm.textstats import IS_START

LEAST, MOST = 16, 256
RUN = 100
CUT_BITS = 5

_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)

CHUNKS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64())])


def ends_of(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one being its length."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # after a step the hash holds twice as many bytes
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    cut = np.flatnonzero((h[:-1] >> np.uint16(16 - CUT_BITS) == 0) & IS_START[data[1:]]) + 1
    cut = cut[np.diff(cut, prepend=-LEAST) >= LEAST]
    ends = np.append(cut[cut >= LEAST], len(data))
    begins = np.concatenate([[0], ends[:-1]])
    ends = ends[ends > begins]
    long = np.flatnonzero(ends - begins[: len(ends)] > MOST)
    if len(long):
        more = [np.arange(begins[i] + MOST, ends[i], MOST) for i in long]
        start = np.append(np.flatnonzero(IS_START[data]), len(data))
        more = start[np.searchsorted(start, np.concatenate(more))]
        ends = np.union1d(ends, more)
    return ends


def digests_of(text: bytes, ends: np.ndarray) -> list[bytes]:
    out, begin = [], 0
    for end in ends.tolist():
        out.append(xxhash.xxh3_128_digest(text[begin:end]))
        begin = end
    return out


def chunk_rows(texts: DataFrame) -> DataFrame:
    """(d1, d2, doc_id): the distinct chunks of each row."""

    def run(batches):
        for ids, part in runs(batches):
            found, owner = [], []
            for doc_id, text in zip(ids, part, strict=True):
                if doc_id is not None:
                    own = set(digests_of(text, ends_of(text)))
                    found.extend(own)
                    owner.extend([doc_id] * len(own))
            if found:
                d = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
                yield record(CHUNKS, d[:, 0], d[:, 1], owner)

    return texts.mapInArrow(run, "d1 long, d2 long, doc_id long")


def repeats(texts: DataFrame) -> DataFrame:
    """(repeat_id, repeated): for each document the digests of its chunks that a document of smaller id has too."""
    rows = chunk_rows(texts)
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    later = rows.join(first.where("first < last").drop("last"), ["d1", "d2"]).where("doc_id > first")
    return later.groupBy(F.col("doc_id").alias("repeat_id")).agg(F.collect_set(F.struct("d1", "d2")).alias("repeated"))


def removed_spans(text: bytes, repeated: set[bytes], least: int = RUN) -> list[tuple[int, int]]:
    """Byte spans to remove from a text."""
    ends = ends_of(text)
    spans, seen, begin, since = [], set(), 0, None
    for end, digest in zip(ends.tolist(), digests_of(text, ends), strict=True):
        if digest in repeated or digest in seen:
            since = begin if since is None else since
        elif since is not None:
            spans.append((since, begin))
            since = None
        seen.add(digest)
        begin = end
    if since is not None:
        spans.append((since, begin))
    return [(a, b) for a, b in spans if b - a >= least]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = RUN) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``; ``kept`` of a null text is null."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("kept", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )

    def run(batches):
        for batch in batches:
            at = 0
            for ids, part in runs(iter([batch])):
                rows = []
                here = batch.slice(at, len(ids))
                for doc_id, text, repeated, none in zip(ids, part, here.column(2), here.column(1).is_null(), strict=True):
                    pairs = repeated.as_py() or ()
                    known = {np.asarray([p["d1"], p["d2"]], dtype=np.int64).tobytes() for p in pairs}
                    spans = removed_spans(text, known, least)
                    kept = without(text, spans) if spans else text
                    digest = hashlib.sha256(kept).hexdigest()
                    rows.append((doc_id, None if none.as_py() else kept.decode(), len(text), len(text) - len(kept), len(spans), digest))
                yield record(schema, *map(list, zip(*rows, strict=True)))
                at += len(ids)

    texts = id_and_text(docs, id_col, text_col)
    given = texts.join(written(repeats(texts), "repeats"), F.col("id") == F.col("repeat_id"), "left").drop("repeat_id")
    return given.mapInArrow(
        run, "doc_id long, kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", least: int = RUN) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; all rows and columns stay, ``length_col`` follows the text.

    The text of a row goes through the operator together with the row's other columns, so ids need not be unique.
    """
    found, of, repeated = repeats(id_and_text(docs, id_col, text_col)), fresh("of"), fresh("repeated")
    found = written(found.select(F.col("repeat_id").alias(of), F.col("repeated").alias(repeated)), "repeats")
    given = docs.join(found, docs[id_col].cast("long") == F.col(of), "left")
    text = _cut(least)(F.col(text_col).cast("string"), F.col(repeated))
    out = given.withColumn(text_col, text.cast(docs.schema[text_col].dataType))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def _cut(least: int):
    @F.arrow_udf("string")
    def cut(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        out = []
        for text, pairs in zip(texts, repeated, strict=True):
            text = text.as_py()
            if text:
                raw = text.encode()
                known = {np.asarray([p["d1"], p["d2"]], dtype=np.int64).tobytes() for p in pairs.as_py() or ()}
                spans = removed_spans(raw, known, least)
                text = without(raw, spans).decode() if spans else text
            out.append(text)
        return pa.array(out, pa.string())

    return cut
