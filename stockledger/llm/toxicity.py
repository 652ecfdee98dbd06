"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as the vector of its hash and the mean vector of its hashed byte trigrams, so unseen words resemble
words spelled alike. Two gated recurrences read a window of ``SPAN`` words in both directions, attention pools their
states, and a logistic unit scores the window. Windows overlap by half; every window of every text is
scored, and a text's score is its highest.

The network is trained in numpy on a bounded sample of labelled documents (``max_rows`` toxic and twice as many clean ones,
of at most ``max_chars``). As labels name documents, not windows, each toxic document teaches by its most suspicious window:
at first the one with the highest log-odds of its trigrams, later the one the network itself ranks highest;
clean documents teach by random windows and by those ranked highest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import Ids, id_and_text, offsets_of, record, runs, text_runs
from stockledger.llm.quality import held_out, sample

SPAN, STEP = 24, 12
WORD_BUCKETS, GRAM_BUCKETS = 4096, 32_768
WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 8, 16, 8, 8

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_windows", pa.int64())])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Windows:
    """Windows of a run of texts: word numbers (0 is padding) and, by number, word buckets and trigram buckets."""

    def __init__(self, texts: list[bytes]):
        numbers = Ids(1)
        words = [t.lower().split() for t in texts]
        self.counts = np.asarray([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter((numbers[w] for ws in words for w in ws), dtype=np.int64, count=self.counts.sum())
        self.of = np.repeat(np.arange(len(texts)), np.maximum(1, -(-np.maximum(self.counts - SPAN, 0) // STEP) + 1))
        self.first = offsets_of(np.bincount(self.of, minlength=len(texts)))
        at = (np.arange(len(self.of)) - self.first[self.of]) * STEP
        at = np.minimum(at, np.maximum(self.counts[self.of] - SPAN, 0))[:, None] + np.arange(SPAN)
        inside = at < self.counts[self.of][:, None]
        begins = offsets_of(self.counts)[self.of][:, None]
        flat = np.append(flat, 0)
        self.ids = np.where(inside, flat[np.where(inside, begins + at, len(flat) - 1)], 0)
        vocabulary = [b"", *numbers]
        self.words = np.asarray([zlib.crc32(w) % WORD_BUCKETS for w in vocabulary])
        letters = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in vocabulary), dtype=np.uint8).astype(np.int64)
        grams = (letters[:-2] * 65_599 + letters[1:-1]) * 65_599 + letters[2:]
        ends = offsets_of([len(w) + 2 for w in vocabulary])
        # The padding's two letters have no trigram of their own; its row is never read.
        keep = np.ones(len(letters), dtype=bool)
        keep[ends[1:] - 1] = keep[ends[1:] - 2] = False
        self.grams = ((grams ^ (grams >> 15)) % GRAM_BUCKETS)[keep[:-2]]
        self.grams_at = offsets_of(np.maximum(0, np.diff(ends) - 2))

    def __len__(self) -> int:
        return len(self.ids)


class Network:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        size, h = WORD_SIZE + GRAM_SIZE, HIDDEN
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "words": normal(WORD_BUCKETS, WORD_SIZE, scale=0.1),
            "grams": normal(GRAM_BUCKETS, GRAM_SIZE, scale=0.1),
            "attend": normal(2 * h, ATTENTION, scale=0.4),
            "asked": normal(ATTENTION, scale=0.4),
            "out": normal(2 * h, scale=0.4),
            "bias": np.zeros(1, dtype=np.float32),
        }
        for side in "fb":
            self.p |= {
                f"x{side}": normal(size, 3 * h, scale=size**-0.5),
                f"c{side}": np.zeros(3 * h, dtype=np.float32),
                f"g{side}": normal(h, 2 * h, scale=h**-0.5),
                f"n{side}": normal(h, h, scale=h**-0.5),
            }

    def inputs(self, words: np.ndarray, grams: np.ndarray, grams_at: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        sums = np.zeros((len(words), GRAM_SIZE), dtype=np.float32)
        n = np.diff(grams_at)
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.p["grams"][grams], grams_at[full], axis=0) / n[full][:, None]
        return np.hstack([self.p["words"][words], sums])

    def _read(self, side: str, given: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction after each word; ``given`` holds the words' parts of the three gates."""
        gates, new, h = self.p[f"g{side}"], self.p[f"n{side}"], HIDDEN
        state = np.zeros((len(ids), h), dtype=np.float32)
        states = np.empty((SPAN, len(ids), h), dtype=np.float32)
        for t in range(SPAN) if side == "f" else reversed(range(SPAN)):
            own = given[ids[:, t]]
            both = 1 / (1 + np.exp(-(own[:, : 2 * h] + state @ gates)))
            update = both[:, :h] * (ids[:, t] > 0)[:, None]
            reset = both[:, h:]
            candidate = np.tanh(own[:, 2 * h :] + (reset * state) @ new)
            if keep is not None:
                keep.append((t, state, both, update, candidate))
            state = state + update * (candidate - state)
            states[t] = state
        return states

    def _pool(self, states: np.ndarray, ids: np.ndarray):
        seen = np.tanh(states @ self.p["attend"])
        weight = seen @ self.p["asked"]
        weight = np.where(ids.T > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight = weight / weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return seen, weight, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def scores(self, windows: Windows, block: int = 4096) -> np.ndarray:
        """Log-odds of each window."""
        x = self.inputs(windows.words, windows.grams, windows.grams_at)
        given = {side: x @ self.p[f"x{side}"] + self.p[f"c{side}"] for side in "fb"}
        out = np.empty(len(windows), dtype=np.float32)
        for at in range(0, len(windows), block):
            ids = windows.ids[at : at + block]
            states = np.concatenate([self._read(side, given[side], ids) for side in "fb"], axis=2)
            out[at : at + block] = self._pool(states, ids)[3]
        return out

    def gradients(
        self, words, grams, grams_at, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, known: np.ndarray | None = None
    ) -> dict:
        """Gradients of the weighted logistic loss of windows over the distinct words given.

        ``known`` is 0 for words of which the word's own vector is left out, so that spelling must do.
        """
        h, d = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.inputs(words, grams, grams_at)
        known = np.ones(len(words), dtype=np.float32) if known is None else known
        x[:, :WORD_SIZE] *= known[:, None]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate(
            [self._read(s, x @ self.p[f"x{s}"] + self.p[f"c{s}"], ids, kept[s]) for s in "fb"], axis=2
        )
        seen, weight, pooled, logit = self._pool(states, ids)
        d_logit = ((_sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        d["out"], d["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d["asked"] = np.einsum("tb,tba->a", d_weight, seen)
        d_seen = d_weight[:, :, None] * self.p["asked"] * (1 - seen**2)
        d["attend"] = np.einsum("tbh,tba->ha", states, d_seen)
        d_states += d_seen @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            gates, new = self.p[f"g{side}"], self.p[f"n{side}"]
            d_given = np.zeros((len(x), 3 * h), dtype=np.float32)
            carried = np.zeros((len(ids), h), dtype=np.float32)
            for t, state, both, update, candidate in reversed(kept[side]):
                total = d_states[t][:, k * h : (k + 1) * h] + carried
                reset = both[:, h:]
                d_new = total * update * (1 - candidate**2)
                d_reset_state = d_new @ new.T
                d[f"n{side}"] += (reset * state).T @ d_new
                d_update = total * (candidate - state) * (ids[:, t] > 0)[:, None]
                d_both = np.hstack([d_update, d_reset_state * state]) * both * (1 - both)
                d[f"g{side}"] += state.T @ d_both
                carried = total * (1 - update) + d_reset_state * reset + d_both @ gates.T
                np.add.at(d_given, ids[:, t], np.hstack([d_both, d_new]))
            d[f"x{side}"], d[f"c{side}"] = x.T @ d_given, d_given.sum(axis=0)
            d_x += d_given @ self.p[f"x{side}"].T
        np.add.at(d["words"], words, d_x[:, :WORD_SIZE] * known[:, None])
        n = np.diff(grams_at)
        owner = np.repeat(np.arange(len(words)), n)
        np.add.at(d["grams"], grams, d_x[owner, WORD_SIZE:] / n[owner][:, None])
        return d


def _some(windows: Windows, rows: np.ndarray):
    """The distinct words of some windows, and those windows in their numbers."""
    used, ids = np.unique(np.append(windows.ids[rows].ravel(), 0), return_inverse=True)
    ids = ids[:-1].reshape(len(rows), SPAN)
    n = np.diff(windows.grams_at)[used]
    at = offsets_of(n)
    grams = windows.grams[np.repeat(windows.grams_at[used] - at[:-1], n) + np.arange(at[-1])]
    return windows.words[used], grams, at, ids


def _suspicion(windows: Windows, labels: np.ndarray) -> np.ndarray:
    """For each window the sum of its three highest log-odds of trigrams, by the documents that hold them."""
    size = len(labels)
    owner = np.repeat(np.arange(len(windows.words)), np.diff(windows.grams_at))
    by_word = [windows.grams[a:b] for a, b in zip(windows.grams_at, windows.grams_at[1:], strict=False)]
    held = np.zeros((2, GRAM_BUCKETS))
    for doc in range(size):
        used = np.unique(windows.ids[windows.first[doc] : windows.first[doc + 1]])
        found = np.unique(np.concatenate([by_word[w] for w in used]))
        held[int(labels[doc]), found] += 1
    total = np.maximum(1, np.bincount(labels.astype(int), minlength=2))
    odds = np.log((held[1] + 0.5) / (total[1] + 1)) - np.log((held[0] + 0.5) / (total[0] + 1))
    word = np.full(len(windows.words), -20.0)
    np.maximum.at(word, owner, odds[windows.grams])
    return np.sort(word[windows.ids], axis=1)[:, -3:].sum(axis=1)


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 3, epochs: int = 3, batch: int = 256, rate: float = 4e-3, decay: float = 0.01) -> Network:
    """A network for these documents. With none, or one label only, it is left untrained but for its bias."""
    net, draw = Network(), np.random.default_rng(11)
    if len(texts) == 0 or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["bias"][:] = 0 if len(texts) == 0 else np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
        return net
    windows = Windows(texts)
    order = _suspicion(windows, labels)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0
    for turn in range(rounds):
        if turn:
            order = net.scores(windows)
        top = np.lexsort((-order, windows.of))
        ranked = [top[windows.first[d] : windows.first[d + 1]] for d in range(len(texts))]
        rows = [r[:1] if y else np.append(r[:2], draw.choice(r, 1)) for r, y in zip(ranked, labels, strict=True)]
        of = np.repeat(labels, [len(r) for r in rows])
        rows = np.concatenate(rows)
        weights = np.where(of > 0, (of == 0).sum() / max(1, (of > 0).sum()), 1.0)
        for _ in range(epochs):
            shuffled, size = draw.permutation(len(rows)), max(16, min(batch, len(rows) // 40))
            for at in range(0, len(rows), size):
                part = shuffled[at : at + size]
                some = _some(windows, rows[part])
                known = (draw.random(len(some[0])) < 0.3).astype(np.float32)
                d = net.gradients(*some, of[part], weights[part], known)
                steps += 1
                for k, g in d.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.002 * (g * g - second[k])
                    net.p[k] *= 1 - rate * decay
                    net.p[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.998**steps)) + 1e-7)
    return net


def learned(
    docs: DataFrame, labels: DataFrame, folds: int, fold: int, label_col: str, max_rows: int, max_chars: int, id_col: str, text_col: str
) -> Network:
    """A network for the sample of labelled documents described in ``scored``."""
    texts = id_and_text(docs, id_col, text_col)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    chosen = sample(usable.where("label = 1"), "id", max_rows).union(sample(usable.where("label = 0"), "id", 2 * max_rows))
    # The sample's ids are at most 3 * max_rows, and its texts at most that many times max_chars.
    taught = texts.where(F.length("text") <= max_chars).join(F.broadcast(chosen), "id").orderBy("id").toPandas()
    return train([t.encode() for t in taught["text"]], taught["label"].to_numpy(dtype=float))


def score_texts(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(score, windows) of each text: the highest of its windows."""
    windows = Windows(texts)
    best = np.maximum.reduceat(net.scores(windows), windows.first[:-1])
    return _sigmoid(best.astype(float)), np.diff(windows.first)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    fold: int = 1,
    label_col: str = "toxic",
    cut: float = 0.7,
    max_rows: int = 1500,
    max_chars: int = 32_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows), one row for each row of ``docs``, with all windows scored.

    Learns from rows of ``labels`` outside the held-out fold, at most ``max_rows`` toxic and twice as many clean ones, of
    at most ``max_chars``. A text without words is one empty window and gets its score. Labels that are null or without
    a document teach nothing; without usable labels all scores are 0.5.
    """
    texts = id_and_text(docs, id_col, text_col)
    net = learned(docs, labels, folds, fold, label_col, max_rows, max_chars, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        own = Network()
        own.p = shared.value
        for ids, part in runs(batches):
            yield record(SCORES, ids, *score_texts(own, part))

    return texts.mapInArrow(run, "doc_id long, score double, n_windows long").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        "n_windows",
    )


def clean(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    fold: int = 1,
    label_col: str = "toxic",
    cut: float = 0.7,
    max_rows: int = 1500,
    max_chars: int = 32_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``cut``; trained as in ``scored``. Every row is judged by its own text."""
    net = learned(docs, labels, folds, fold, label_col, max_rows, max_chars, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Network()
        own.p = shared.value
        for column in texts:
            parts = [score_texts(own, part)[0] for part in text_runs(column)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) < cut)
