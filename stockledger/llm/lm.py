"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and an end of text are counted over all training texts. The most frequent
are symbols of the model: one in ``SHARE`` of the distinct words, ``own`` at least. All others share a sixth as many
symbols (``CLASSES`` at least), told apart by a hash of their last letters, and within its symbol a word has its smoothed
share of the counts. So probabilities over all known words and one unknown word sum to 1, and the model grows with
the vocabulary.

The model predicts a symbol by the bilinear form of a context vector and a target vector, plus a bias. The context is the
symbol before (or the beginning). The counts of all distinct pairs of neighbouring symbols in all training texts are a Spark
table. Tasks train on its partitions from the same parameters, by stochastic gradients that tell pairs from noise drawn
from symbol frequencies; their parameters are averaged by how often a task touched them, ``ROUNDS`` times. No pair
is left to chance: each is visited in every round, those above the mean count as often as they hold it. The
normaliser of every context, over all symbols, is then computed in tasks, so log-probabilities are exact.

Counts of the ``head`` most frequent words go to all tasks; the rest meet their documents in a join by word, after
each document has counted its own words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import id_and_text, offsets_of, record, runs, written
from stockledger.llm.quality import held_out

OWN = 1536
CLASSES = 256
SHARE = 128
ROUNDS = 2
HEAD = 50_000
SIZE = 24
END = b"\n"  # no word: words hold no white space
LN10 = float(np.log(10))

COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
ROWS = pa.schema([("block", pa.int32()), ("rows", pa.binary())])
NORMS = pa.schema([("block", pa.int64()), ("norms", pa.binary())])
PARTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("model", pa.float64()),
        ("words", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int32())),
    ]
)


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, n) over all texts; each task adds up what it can hold before the shuffle."""

    def run(batches):
        found: Counter[bytes] = Counter()
        for _, part in runs(batches):
            for text in part:
                found.update(tokens_of(text))
            if len(found) > flush:
                yield record(COUNTS, list(found), list(found.values()))
                found.clear()
        if found:
            yield record(COUNTS, list(found), list(found.values()))

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all that are counted at least so often; the most frequent first.

    The bound comes from how many words there are of each eighth of a power of two, so only the answer reaches the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    sizes = sorted(counts.groupBy(step).count().collect(), reverse=True)
    room, least = most, None
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    if least is None:
        return []
    found = counts.where(F.floor(F.log2("n") * 8) >= least).collect()
    return sorted(((bytes(r.word), r.n) for r in found), key=lambda x: (-x[1], x[0]))


def sizes_of(distinct: int, own: int = OWN) -> tuple[int, int]:
    """How many words get symbols of their own, of those there are, and how many symbols the others share."""
    own = max(own, distinct // SHARE)
    return own, max(CLASSES, own // 6)


def class_of(word: bytes, classes: int) -> int:
    """Class of a word without a symbol of its own: by its last letters, without the marks after them."""
    return zlib.crc32(word.rstrip(b".,;:!?|")[-3:]) % classes


class Symbols(dict):
    """Symbol of each word; words looked up once are remembered, up to a bound."""

    def __init__(self, own: list[bytes], classes: int):
        super().__init__({w: i for i, w in enumerate(own)})
        self.own, self.classes = len(own), classes
        self.start = self.own + classes  # only ever a context

    def __missing__(self, word: bytes) -> int:
        symbol = self.own + class_of(word, self.classes)
        if len(self) < self.own + 400_000:
            self[word] = symbol
        return symbol

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


class Places(dict):
    """Place of each word in the head, from 0; of any other word -1 less its class. Words looked up once are remembered, up to a bound."""

    def __init__(self, head: list[bytes], classes: int):
        super().__init__({w: i for i, w in enumerate(head)})
        self.most, self.classes = len(head) + 400_000, classes

    def __missing__(self, word: bytes) -> int:
        place = -1 - class_of(word, self.classes)
        if len(self) < self.most:
            self[word] = place
        return place


def tokens_in(part: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of some texts in a row, and where each text begins."""
    tokens = [tokens_of(text) for text in part]
    return list(chain.from_iterable(tokens)), offsets_of([len(t) for t in tokens])[:-1]


def before_of(after: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """The symbol before each; ``start`` at the beginning of a text."""
    before = np.roll(after, 1)
    before[starts] = start
    return before


def pair_counts(texts: DataFrame, own: list[bytes], classes: int, flush: int = 3 << 20) -> DataFrame:
    """(pair, n) of neighbouring symbols over all texts: before * (symbols + 1) + after; every text begins after the start symbol."""
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        symbols = Symbols(shared.value, classes)
        width = symbols.start + 1
        found, size = [], 0
        for _, part in runs(batches):
            tokens, starts = tokens_in(part)
            after = symbols.of(tokens)
            found.append(before_of(after, starts, symbols.start) * width + after)
            size += len(after)
            if size >= flush:
                yield record(PAIRS, *np.unique(np.concatenate(found), return_counts=True))
                found, size = [], 0
        if found:
            yield record(PAIRS, *np.unique(np.concatenate(found), return_counts=True))

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Parameters with their past squared gradients, a row for each symbol (the last one for the start), and how often each was used.

    Columns: context and past, target and past, bias and past, uses as context, uses as target or noise.
    """

    WIDTH = 2 * SIZE + 6

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.contexts, self.targets, self.bias = rows[:, :SIZE], rows[:, SIZE + 1 : 2 * SIZE + 1], rows[:, 2 * SIZE + 2]
        self.past = rows[:, SIZE], rows[:, 2 * SIZE + 1], rows[:, 2 * SIZE + 3]
        self.uses = rows[:, 2 * SIZE + 4], rows[:, 2 * SIZE + 5]

    @classmethod
    def fresh(cls, unigram: np.ndarray, draw: np.random.Generator) -> Model:
        rows = np.zeros((len(unigram) + 1, cls.WIDTH), dtype=np.float32)
        model = cls(rows)
        model.contexts[:] = draw.standard_normal(model.contexts.shape) * 0.1
        model.targets[:] = draw.standard_normal(model.targets.shape) * 0.1
        model.bias[:-1] = np.log(unigram)
        for past in model.past:
            past[:] = 1e-2
        return model

    def parameters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.contexts, self.targets[:-1], self.bias[:-1]


def mean_of(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of models that began alike, averaged by how often each was used."""
    total = np.zeros(parts[0].shape, dtype=np.float64)
    for rows in parts:
        for uses, a, b in ((-2, 0, SIZE + 1), (-1, SIZE + 1, 2 * SIZE + 4)):
            weight = rows[:, uses].astype(np.float64) + 1e-6
            total[:, a:b] += rows[:, a:b] * weight[:, None]
            total[:, uses] += weight
    total[:, : SIZE + 1] /= total[:, -2:-1]
    total[:, SIZE + 1 : -2] /= total[:, -1:]
    return total.astype(np.float32)


def visits_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, weight) of the visits of one pass: all pairs, and by weight as often as they are counted.

    Pairs above the mean count are visited once for each time they hold it, so there are at most twice as many visits as pairs.
    """
    mean = n.mean()
    times = np.ceil(n / mean).astype(np.int64)
    pair = np.repeat(np.arange(len(n)), times)
    return pair, (n / (times * mean))[pair].astype(np.float32)


def train(
    before: np.ndarray, after: np.ndarray, n: np.ndarray, symbols: int, noise: int = 20, steps: int = 3000,
    batch: int = 1024, rate: float = 0.1, seed: int = 3, *, unigram: np.ndarray | None = None, model: Model | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, targets, bias) of the log-bilinear model, by noise-contrastive estimation; ``model`` is trained further.

    Passes over all pairs, as many as make ``steps`` steps and one at least, tell each from noise symbols drawn by frequency;
    the model's unnormalised score less the log of the noise's expected number is the log-odds that a symbol is no noise. Steps
    are scaled by the root of past squared gradients. Without pairs the model is the smoothed frequencies.
    """
    draw = np.random.default_rng(seed)
    if unigram is None:
        unigram = np.bincount(after, weights=n, minlength=symbols) + 0.5
        unigram = unigram / unigram.sum()
    model = Model.fresh(unigram, draw) if model is None else model
    contexts, targets, bias = model.contexts, model.targets, model.bias
    if not len(n):
        contexts[:] = 0
        return model.parameters()
    noise_ends = np.cumsum(unigram)
    odds = np.log(noise * unigram).astype(np.float32)
    # The noise symbols of a step are shared by its pairs, which makes their scores one matrix product.
    share = np.float32(1 / 8)

    small = np.uint16 if symbols < 1 << 16 else np.int64  # short numbers are sorted by their digits

    def sums(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different rows, the sum of the gradients of each, and how many there are."""
        order = np.argsort(rows.astype(small), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        return rows[first], np.add.reduceat(gradient[order], first, axis=0), np.diff(np.append(first, len(rows)))

    def step(which: int, values: np.ndarray, used: np.ndarray, total: np.ndarray) -> None:
        past = model.past[which]
        now = past[used] + (total**2 if total.ndim == 1 else np.einsum("ij,ij->i", total, total) / np.float32(SIZE))
        past[used] = now
        scale = rate / np.sqrt(now)
        values[used] += total * (scale if total.ndim == 1 else scale[:, None])

    pairs, weights = visits_of(np.asarray(n, dtype=np.float64))
    few = -(-batch // len(pairs))
    pairs, weights = np.tile(pairs, few), np.tile(weights, few)
    for _ in range(max(1, -(-steps * batch // len(pairs)))):
        order = draw.permutation(len(pairs))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            u, w, much = before[pairs[now]], after[pairs[now]], weights[now]
            false = np.searchsorted(noise_ends, draw.random(noise * 8)).clip(max=symbols - 1)
            c, t, f = contexts[u], targets[w], targets[false]
            right = much / (1 + np.exp((c * t).sum(axis=1) + bias[w] - odds[w]))
            wrong = c @ f.T
            np.subtract(odds[false] - bias[false], wrong, out=wrong)
            np.exp(wrong, out=wrong)
            wrong += 1
            np.divide(-share * much[:, None], wrong, out=wrong)
            used, total, times = sums(u, right[:, None] * t + wrong @ f)
            step(0, contexts, used, total)
            model.uses[0][used] += times
            both = np.empty((len(w) + len(false), SIZE + 1), dtype=np.float32)  # of targets and biases
            both[: len(w), :SIZE], both[: len(w), SIZE] = right[:, None] * c, right
            both[len(w) :, :SIZE], both[len(w) :, SIZE] = wrong.T @ c, wrong.sum(axis=0)
            used, total, times = sums(np.concatenate([w, false]), both)
            step(1, targets, used, total[:, :SIZE])
            step(2, bias, used, total[:, SIZE])
            model.uses[1][used] += times
    return model.parameters()


def trained(pairs: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, steps: int = 3000, block: int = 1024, most: int = 1 << 20) -> Model:
    """The model of a table of pair counts: tasks train on partitions, ``most`` pairs at a time, and their parameters are averaged."""
    spark, symbols = pairs.sparkSession, len(unigram)
    model = Model.fresh(unigram, np.random.default_rng(3))
    for round_ in range(rounds):
        model.uses[0][:] = model.uses[1][:] = 0
        shared = spark.sparkContext.broadcast((model.rows, unigram))

        def run(batches, shared=shared, round_=round_):
            rows, frequency = shared.value
            own = Model(rows.copy())
            found, size, blocks = [], 0, 0

            def learn() -> None:
                pair, n = (np.concatenate(x) for x in zip(*found, strict=True))
                # Few pairs are gone through again and again, but not learned by heart.
                done = min(steps, int(12 * n.sum()) // 1024) // rounds if blocks == 0 and size < most else 1
                train(pair // (symbols + 1), pair % (symbols + 1), n, symbols, steps=done, seed=3 + 1000 * round_ + blocks, unigram=frequency, model=own)

            for batch in batches:
                found.append(tuple(batch.column(k).to_numpy() for k in (0, 1)))
                size += batch.num_rows
                if size >= most:
                    learn()
                    found, size, blocks = [], 0, blocks + 1
            if size:
                learn()
            if size or blocks:
                at = list(range(0, symbols + 1, block))
                for a in at:
                    yield record(ROWS, [a // block], [own.rows[a : a + block].tobytes()])

        def mean(key, group):
            parts = [np.frombuffer(x.as_py(), dtype=np.float32).reshape(-1, Model.WIDTH) for x in group.column("rows")]
            return pa.table([[key[0].as_py()], [mean_of(parts).tobytes()]], schema=ROWS)

        found = pairs.mapInArrow(run, "block int, rows binary").groupBy("block").applyInArrow(mean, "block int, rows binary")
        parts = {r.block: r.rows for r in found.toLocalIterator()}
        shared.unpersist()
        if parts:
            rows = np.concatenate([np.frombuffer(parts[k], dtype=np.float32) for k in sorted(parts)])
            model = Model(rows.reshape(-1, Model.WIDTH).copy())
    return model


def norms(model, block: int = 256, wide: int = 1 << 14) -> np.ndarray:
    """Log of the sum over all symbols of exp(score), of each of some contexts."""
    contexts, targets, bias = model
    total = np.full(len(contexts), -np.inf)
    for at in range(0, len(contexts), block):
        for to in range(0, len(targets), wide):
            scores = contexts[at : at + block] @ targets[to : to + wide].T + bias[to : to + wide]
            high = scores.max(axis=1, keepdims=True)
            scores -= high
            here = np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64)) + high[:, 0]
            total[at : at + block] = np.logaddexp(total[at : at + block], here)
    return total


def norms_in_tasks(spark: SparkSession, shared, contexts: int, block: int = 256) -> np.ndarray:
    """``norms`` of all contexts of a broadcast model, blocks of them in each task."""
    blocks = -(-contexts // block)

    def run(batches):
        c, t, b = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield record(NORMS, [k], [norms((c[k * block : (k + 1) * block], t, b)).tobytes()])

    found = spark.range(0, blocks, 1, min(blocks, 256)).mapInArrow(run, "block long, norms binary").collect()
    return np.concatenate([np.frombuffer(r.norms) for r in sorted(found, key=lambda r: r.block)])


def log_probabilities(contexts: np.ndarray, targets: np.ndarray, bias: np.ndarray, block: int = 256) -> np.ndarray:
    """Natural log-probability of each symbol (columns) after each context (rows); every row sums to 1."""
    out = np.empty((len(contexts), len(targets)), dtype=np.float32)
    for at in range(0, len(contexts), block):
        logits = contexts[at : at + block] @ targets.T + bias
        logits -= logits.max(axis=1, keepdims=True)
        out[at : at + block] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return out


def scored(
    docs: DataFrame,
    folds: int = 5,
    fold: int = 1,
    own: int = OWN,  # at least; see sizes_of
    head: int = HEAD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Learns from texts outside the held-out fold (a null id is outside it). ``base_score`` is the smoothed unigram
    log10-probability, ``score`` the model's. A null or empty text is its end alone. With nothing to learn from, every
    word is unknown.
    """
    texts = id_and_text(docs, id_col, text_col)
    teaching = texts.where(~F.coalesce(held_out(F.col("id"), folds, fold), F.lit(False)))
    counts = written(word_counts(teaching), "words")
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = sums[0] or 0, sums[1]
    own, classes = sizes_of(distinct, own)
    top = frequent(counts, max(head, 2 * own))
    names = [w for w, _ in top[:own]]
    # Words and tokens within each symbol that several words share.
    by_class = (
        counts.mapInArrow(_class_sums(names, classes), "class int, n long, words long")
        .groupBy("class")
        .agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        .collect()
    )
    class_n, class_words = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        class_n[r["class"]], class_words[r["class"]] = r.n, r.words
    unigram = np.concatenate([[n for _, n in top[: len(names)]], class_n]) + 0.5
    pairs = written(pair_counts(teaching, names, classes), "pairs")
    model = trained(pairs, unigram / unigram.sum()).parameters()
    # An unknown word may have any of the shared symbols: each keeps the share of one unseen word.
    class_log = np.log(class_n + 0.5 * (class_words + 1))
    context = docs.sparkSession.sparkContext
    parameters_ = context.broadcast(tuple(np.ascontiguousarray(x) for x in model))
    shared = context.broadcast((top, len(names), norms_in_tasks(docs.sparkSession, parameters_, len(model[0])), class_log))

    def run(batches):
        head_counts, first, normal, class_logs = shared.value
        contexts, targets, bias = parameters_.value
        places = Places([w for w, _ in head_counts], classes)
        # Of the head's words the symbol and the log of the count.
        symbol = np.asarray([i if i < first else first + class_of(w, classes) for i, (w, _) in enumerate(head_counts)] or [0], dtype=np.int64)
        log = np.log(np.asarray([c for _, c in head_counts] or [0], dtype=float) + 0.5)
        start, row = first + classes, 0
        for ids, part in runs(batches):
            tokens, starts = tokens_in(part)
            place = np.fromiter(map(places.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            rare = place < 0  # not in the head
            known = np.where(rare, 0, place)
            after = np.where(rare, first - 1 - place, symbol[known])
            before = before_of(after, starts, start)
            logs = np.where(rare, 0.0, log[known])
            model_ = bias[after].astype(float) - normal[before]
            for at in range(0, len(tokens), 1 << 13):
                some = slice(at, at + (1 << 13))
                model_[some] += np.einsum("ij,ij->i", contexts[before[some]], targets[after[some]])
            in_class = np.flatnonzero(after >= first)
            model_[in_class] += logs[in_class] - class_logs[after[in_class] - first]
            ends = np.append(starts[1:], len(tokens))
            unknown = np.flatnonzero(rare)
            cuts = np.searchsorted(unknown, np.append(starts, len(tokens))).tolist()
            words = list(map(tokens.__getitem__, unknown.tolist()))
            times = [Counter(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield record(
                PARTS, ids, np.arange(row, row + len(ids)), ends - starts, ends - starts - np.diff(cuts), np.add.reduceat(logs, starts),
                np.add.reduceat(model_, starts), [list(x) for x in times], [list(x.values()) for x in times],
            )
            row += len(ids)

    parts = texts.mapInArrow(
        run,
        "doc_id long, row long, n_tokens long, n_known long, base double, model double, words array<binary>, times array<int>",
    ).withColumn("row", F.spark_partition_id().cast("long") * (1 << 40) + F.col("row"))
    parts = written(parts, "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times")
    )
    log = F.log(F.coalesce(F.col("n"), F.lit(0)) + 0.5) * F.col("times")
    found = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(log).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    whole = float(np.log(total + 0.5 * (distinct + 1)))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return parts.drop("words", "times").join(found, "row", "left").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        ((F.col("base") + rare_log - F.col("n_tokens") * whole) / LN10).alias("base_score"),
        ((F.col("model") + rare_log) / LN10).alias("score"),
    )


def _class_sums(names: list[bytes], classes: int):
    schema = pa.schema([("class", pa.int32()), ("n", pa.int64()), ("words", pa.int64())])
    named = set(names)

    def run(batches):
        n, words = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in named:
                    k = class_of(word, classes)
                    n[k] += count
                    words[k] += 1
        at = np.flatnonzero(words)
        yield record(schema, at, n[at], words[at])

    return run
