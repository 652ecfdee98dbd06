"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text of every document, in one pass, and are written. Trees are grown in numpy on
a bounded sample of labelled documents (``max_rows``, the lowest hashes of their ids): values are
put in at most ``BINS`` quantile bins, the gain of each split is read off histograms of gradients, and each tree is
a complete one of fixed depth, so that a forest is three arrays and all rows walk all trees level
by level. The learning rows and the labels never enter a score otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import id_and_text, record, runs, written
from stockledger.llm.textstats import IS_SPACE, IS_START, IS_SYMBOL, TextRun

BINS = 64

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PLAIN = _UPPER | _LOWER | _DIGIT | IS_SPACE | (_BYTES >= 128)
_CLASSES = {
    "upper": _UPPER,
    "lower": _LOWER,
    "digit": _DIGIT,
    "wide": IS_START & (_BYTES >= 128),
    "symbol": IS_SYMBOL,
    "stop": np.isin(_BYTES, list(b".?")),
    "comma": np.isin(_BYTES, list(b",;:")),
    "shout": _BYTES == ord("!"),
    "bar": _BYTES == ord("|"),
    "slash": np.isin(_BYTES, list(b"/\\_=@")),
    "brace": np.isin(_BYTES, list(b"{}[]()<>")),
    "other": ~_PLAIN,
}

FEATURES = [
    "log_words", "mean_word", "word_spread", "distinct_share", "repeat_share", "line_share", "dup_line_share", "words_per_line",
    "entropy", "long_words", *(f"{k}_share" for k in _CLASSES),
]

STATISTICS = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features_of(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all 0 for an empty one."""
    text = TextRun(texts)
    n, chars = text.n_words().astype(float), text.total(IS_START).astype(float)
    per = lambda a, b: a / np.maximum(b, 1)
    sizes = np.asarray([len(w) for w in text.vocabulary] or [0], dtype=np.int64)[text.ids]
    mean = per(text.sums(sizes, text.words_at), n)
    lines, duplicates = text.duplicate_lines()
    # Entropy of a text's words, from the sorted (text, word) pairs.
    of = np.repeat(np.arange(len(texts)), text.n_words())
    pairs, counts = np.unique(of * max(1, len(text.vocabulary)) + text.ids, return_counts=True)
    owner = (pairs // max(1, len(text.vocabulary))).astype(np.int64)
    share = counts / np.maximum(n, 1)[owner]
    entropy = np.bincount(owner, weights=-share * np.log(share), minlength=len(texts))
    columns = [
        np.log1p(n),
        mean,
        np.sqrt(np.maximum(per(text.sums(sizes * sizes, text.words_at), n) - mean**2, 0)),
        per(np.bincount(owner, minlength=len(texts)), n),
        per(text.repeated_words(), n),
        per(lines, n),
        per(duplicates, lines),
        per(n, lines),
        entropy / np.maximum(np.log1p(n), 1),
        per(text.sums(sizes > 24, text.words_at), n),
        *(per(text.total(c), chars) for c in _CLASSES.values()),
    ]
    return np.column_stack(columns).astype(np.float32)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every row; null texts as empty ones."""

    def run(batches):
        for ids, texts in runs(batches):
            yield record(STATISTICS, ids, list(features_of(texts)))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class Forest:
    """Complete trees of one depth: node k has children 2k+1 and 2k+2; leaves follow the inner nodes."""

    features: np.ndarray  # trees x inner nodes
    limits: np.ndarray  # trees x inner nodes; at most the limit goes left
    values: np.ndarray  # trees x leaves
    bias: float

    def raw(self, rows: np.ndarray, block: int = 4096) -> np.ndarray:
        trees, inner = self.features.shape
        base = np.arange(trees)[None, :] * inner
        features, limits, values = self.features.ravel(), self.limits.ravel(), self.values.ravel()
        out = np.empty(len(rows))
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            node = np.zeros((len(part), trees), dtype=np.int64)
            each = np.arange(len(part))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                here = base + node
                node = 2 * node + 1 + (part[each, features[here]] > limits[here])
            leaf = np.arange(trees)[None, :] * (inner + 1) + node - inner
            out[at : at + block] = self.bias + values[leaf].sum(axis=1)
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def grow(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, least: int = 10, ridge: float = 1.0
) -> Forest:
    """Boost logistic loss. With no rows, or one label only, the forest says that label's smoothed share."""
    n, width = rows.shape
    inner = (1 << depth) - 1
    share = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Forest(np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 2)), bias)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(edges[j], rows[:, j], "left") for j in range(width)])
    raw = np.full(n, bias)
    all_features, all_limits, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - labels, p * (1 - p)
        features, limits = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, size = (1 << level) - 1, 1 << level
            local = node - first
            g, h, c = (np.zeros((size, width, BINS)) for _ in range(3))
            for j in range(width):
                key = local * BINS + binned[:, j]
                for out, w in ((g, gradient), (h, weight), (c, None)):
                    out[:, j] = np.bincount(key, weights=w, minlength=size * BINS).reshape(size, BINS)
            gl, hl, cl = (x.cumsum(axis=2) for x in (g, h, c))
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = 0
            best = gain.reshape(size, -1).argmax(axis=1)
            for k in range(size):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    features[first + k], limits[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (rows[np.arange(n), features[node]] > limits[node])
        leaf = node - inner
        g = np.bincount(leaf, weights=gradient, minlength=inner + 1)
        h = np.bincount(leaf, weights=weight, minlength=inner + 1)
        values = -rate * g / (h + ridge)
        raw = raw + values[leaf]
        all_features.append(features)
        all_limits.append(limits)
        all_values.append(values)
    return Forest(np.array(all_features), np.array(all_limits), np.array(all_values), bias)


def sample(labelled: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, those with the lowest hash of their id: the same ones every time."""
    return labelled.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def scored(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    fold: int = 2,
    label_col: str = "quality",
    cut: float = 0.7,
    max_rows: int = 40_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Learns from rows of ``labels`` outside the held-out fold. Labels that are null, or whose document is missing or has no
    id, teach nothing; several labels of a document count each. A document without text has all statistics 0, and a
    score. Without any usable label every score is 0.5.
    """
    known = written(statistics(docs, id_col, text_col), "statistics")
    usable = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    usable = usable.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    taught = sample(known.join(usable, "doc_id"), "doc_id", max_rows).toPandas()
    rows = np.array(taught["features"].tolist(), dtype=np.float32).reshape(len(taught), len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(grow(rows, taught["label"].to_numpy(dtype=float)))

    def run(batches):
        forest = shared.value
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield record(SCORES, batch.column(0), forest.probability(values))

    scores = known.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return scores.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
