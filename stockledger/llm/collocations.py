"""Phrase collocations by SETM: relations of occurrences, extended by merge joins, of frequent phrases only.

Texts, ASCII letters lower-cased, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; phrases lie within a piece and count
by language (null: ``und``). The occurrences of the phrases of k words are a written relation (block, place, phrase), sorted by place, in which
pieces are apart by a place that nothing stands on. A block holds about ``BLOCK_WORDS`` words of one language, cut at the end of a piece. To go from k
words to k + 1:

1. merge join of the relation with itself on adjacent places: two frequent phrases that overlap in all but a word. Sorted columns, so a
   comparison of neighbours; equal pairs of a block are counted at once;
2. group count over all blocks, of the blocks' own counts, and semi-join of those with the groups that have support enough. Both
   need the pairs dealt by pair, so they share one shuffle: each block's count meets the sum of its group, and goes or stays;
3. what stays goes back to its block, and the occurrences that it names are written as the next relation.

A phrase is known by the names of its first k and its last k words, so counts are exact and no text is shuffled beyond single words. Its own name is the
least of the numbers its blocks gave it. Nothing is broadcast by hand: the frequent phrases may be as many as they are. A pair has one row in each block, so
no phrase is a hot key. The counts of all beginnings and ends of a phrase come along the same two names.

Null and empty texts have no words. Documents need no id. A language with fewer candidates than the limit gives them all; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockledger.llm.common import Ids, fresh, released, text_runs, written

BLOCK_WORDS = 1 << 21
SUPPORT = 100
LONGEST = 5
NUMBER_BITS = 24  # of a phrase within its block; a block with more reserves the numbers of the next blocks
BLOCK_BITS = 16  # of a block within its task
COVERED = 100
LIMIT = 2000
SALTS = 16
UNKNOWN = "und"
EXACT = "decimal(38,0)"

# Rows hold up to some megabytes, so pages are looked at after each row instead of after a hundred; zstd works in small buffers.
BLOB_PAGES = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}

_STOPS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_GAP = b"."
_LONG_TEXT = 1 << 22

OCCURRENCES = pa.schema(
    [("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("vocabulary", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
)
RELATION = pa.schema([("block", pa.int64()), ("steps", pa.binary()), ("numbers", pa.binary()), ("names", pa.binary())])
PAIRS = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("own", pa.int64()), ("n", pa.int64())])


class _Block:
    """The words of one language that a task has gathered, by number; 0 stands between pieces."""

    def __init__(self):
        self.numbers = Ids()
        self.numbers[_GAP] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        tokens = _STOPS.sub(b" . ", text.lower()).split()
        tokens.append(_GAP)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        words = np.concatenate(self.parts)
        counts = np.bincount(words, minlength=len(self.numbers))
        columns = [[number], [lang], [words.tobytes()], [list(self.numbers)[1:]], [counts[1:]]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, OCCURRENCES)], schema=OCCURRENCES)


def _pieces(text: bytes):
    """The text in parts of some megabytes, each ending where a piece does (a piece is never cut)."""
    at = 0
    while len(text) - at > _LONG_TEXT:
        stop = _STOPS.search(text, at + _LONG_TEXT)
        if stop is None:
            break
        yield text[at : stop.end()]
        at = stop.end()
    yield text[at:]


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Blocks of words with the words they hold: block, lang, words (numbers in the block), vocabulary, counts."""
    limit = BLOCK_WORDS

    def run(batches):
        number, size, open_ = TaskContext.get().partitionId() << BLOCK_BITS, 0, {}
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for texts in text_runs(batch.column(1)):
                for lang, text in zip(langs[at:], texts):
                    for part in _pieces(text):
                        block = open_.setdefault(lang, _Block())
                        before = block.size
                        block.add(part)
                        size += block.size - before
                        if size >= limit:
                            for name in list(open_):
                                block = open_.pop(name)
                                yield block.row(number, name)
                                number += 1 + (block.size >> NUMBER_BITS)
                            size = 0
                at += len(texts)
        for name, block in open_.items():
            yield block.row(number, name)
            number += 1 + (block.size >> NUMBER_BITS)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    frame = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "block long, lang string, words binary, vocabulary array<binary>, counts array<long>")


_RELATION_DDL = "block long, steps binary, numbers binary, names binary"


def _relation(block: int, places: np.ndarray, numbers: np.ndarray, names: np.ndarray) -> pa.Table:
    """A block's occurrences: steps from place to place, the number of the phrase at each, and the phrases' names by number."""
    row = [[block], [np.diff(places, prepend=0).astype(np.int32).tobytes()], [numbers.astype(np.int32).tobytes()], [names.astype(np.int64).tobytes()]]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, RELATION)], schema=RELATION)


def _word_relation(words: pa.Table, kept: pa.Table) -> pa.Table:
    """Places of the frequent words of a block."""
    if not words.num_rows or not kept.num_rows:
        return RELATION.empty_table()
    written_as = np.frombuffer(words.column("words")[0].as_py(), dtype=np.int32)
    block = words.column("block")[0].as_py()
    no, names = kept.column("own").to_numpy() - (block << NUMBER_BITS), kept.column("id").to_numpy()
    number = np.full(max(int(written_as.max(initial=0)), int(no.max())) + 1, -1, dtype=np.int32)
    number[no] = np.arange(len(no))
    numbers = number[written_as]
    places = np.flatnonzero(numbers >= 0)
    return _relation(block, places, numbers[places], names)


def _adjacent(steps: pa.Scalar, numbers: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join on the next place: the places that have one, with a code of the two phrases that stand there."""
    step, number = (np.frombuffer(c.as_buffer(), dtype=np.int32) for c in (steps, numbers))
    met = np.flatnonzero(step[1:] == 1)
    return np.cumsum(step, dtype=np.int64)[met], number[met].astype(np.int64) * size + number[met + 1]


def _pairs(batches):
    """The pairs of adjacent phrases of each block, counted."""
    for batch in batches:
        for block, steps, numbers, named in zip(*batch.columns):
            names = np.frombuffer(named.as_buffer(), dtype=np.int64)
            pair, n = np.unique(_adjacent(steps, numbers, len(names))[1], return_counts=True)
            if len(pair):
                own = (block.as_py() << NUMBER_BITS) + np.arange(len(pair))
                columns = names[pair // len(names)], names[pair % len(names)], own, n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=PAIRS)


def _longer_relation(relation: pa.Table, kept: pa.Table) -> pa.Table:
    """Places of a block where a kept pair stands, under the pair's own name."""
    if not relation.num_rows or not kept.num_rows:
        return RELATION.empty_table()
    block, steps, numbers, named = (c[0] for c in relation.columns)
    places, code = _adjacent(steps, numbers, len(named.as_buffer()) // 8)
    pair = np.unique(code, return_inverse=True)[1]
    no, names = kept.column("own").to_numpy() - (block.as_py() << NUMBER_BITS), kept.column("id").to_numpy()
    number = np.full(len(code), -1, dtype=np.int32)
    number[no] = np.arange(len(no))
    numbers = number[pair]
    there = numbers >= 0
    return _relation(block.as_py(), places[there], numbers[there], names)


def _frequent(counts: DataFrame, phrase: list[str], support: int, name: str) -> DataFrame:
    """The blocks' counts of phrases that have support over all blocks, with the sum ``f`` and the phrase's name ``id``."""
    group = Window.partitionBy(*phrase)
    summed = counts.withColumns({"f": F.sum("n").over(group), "id": F.min("own").over(group)})
    return written(summed.where(F.col("f") >= support).drop("n"), name)


def _kept(relation: DataFrame, frequent: DataFrame, function, name: str) -> DataFrame:
    """Each block's row and what stays of its phrases, brought together by block."""
    stays = frequent.select(F.shiftright("own", NUMBER_BITS).alias("of"), "own", "id")
    kept = relation.groupBy("block").cogroup(stays.groupBy("of")).applyInArrow(function, _RELATION_DDL)
    return written(kept, name, **BLOB_PAGES)


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to ``longest`` words the phrases that occur ``support`` times, and the words of each language.

    Phrases: id, p and q (first and last words but one, null for words), lang, phrase, f, heads and tails (occurrences of its first
    1, 2, ... words and of its last), last (its last word). Words of a language: lang, n.
    """
    # Relations are released as soon as the next one is there; names are this call's own.
    spark, place = docs.sparkSession, fresh("occurrences")
    blocks = written(occurrences(docs, text_col, lang_col), place, **BLOB_PAGES)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = written(blocks.select("lang", size.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("vocabulary", "counts")).alias("no", "word"))
    own = (F.shiftleft("block", NUMBER_BITS) + F.col("no") + 1).alias("own")
    words = words.select("lang", F.col("word.vocabulary").alias("word"), own, F.col("word.counts").alias("n"))
    frequent = _frequent(words, ["lang", "word"], support, "words")
    none, null, text = F.array().cast("array<long>"), F.lit(None).cast("long"), F.col("word").cast("string")
    once = frequent.where("own = id")
    levels = [once.select("id", null.alias("p"), null.alias("q"), "lang", text.alias("phrase"), "f", none.alias("heads"), none.alias("tails"), text.alias("last"))]
    before, place = place, fresh("relation")
    relation = _kept(blocks.select("block", "words"), frequent, _word_relation, place)
    released(spark, before)
    for size in range(2, longest + 1):
        pairs = relation.mapInArrow(_pairs, "p long, q long, own long, n long")
        frequent = _frequent(pairs, ["p", "q"], support, f"phrases-{size}")
        if size < longest:
            before, place = place, fresh("relation")
            relation = _kept(relation, frequent, _longer_relation, place)
            released(spark, before)
        else:
            released(spark, place)
        shorter = levels[-1]
        first = shorter.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("f")).alias("heads"))
        rest = shorter.select(F.col("id").alias("q"), F.concat("tails", F.array("f")).alias("tails"), "last")
        joined = frequent.where("own = id").join(first, "p").join(rest, "q")
        longer = joined.select("id", "p", "q", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", "heads", "tails", "last")
        levels.append(written(longer, f"named-{size}"))
    return levels, totals


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    longest: int = LONGEST,
    covered: int = COVERED,
    limit: int | None = LIMIT,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Phrases of 2 to ``longest`` words by how much more often they occur than their parts would by chance.

    lang, rank, phrase, a (occurrences), l and r (those of its two parts), n (words of the language), score: 1000 * a * n / (l * r), rounded down, at
    the cut where that is least. A phrase is left out where a longer one that holds it has ``covered`` percent of its occurrences. Such a
    phrase has one in between of a word more than it, with as many occurrences at least: so it is enough to look at those.
    """
    levels, totals = frequent_phrases(docs, support, longest, text_col, lang_col)
    candidates = None
    for at in range(1, len(levels)):
        phrases = levels[at]
        if at + 1 < len(levels):
            longer = levels[at + 1]
            most = longer.groupBy(F.col("p").alias("id")).agg(F.max("f").alias("most"))
            most = most.unionByName(longer.groupBy(F.col("q").alias("id")).agg(F.max("f").alias("most")))
            most = most.groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(most, "id", "left").where(F.coalesce(100 * F.col("most") < covered * F.col("f"), F.lit(True)))
        cuts = F.sequence(F.lit(1), F.lit(at))
        parts = F.transform(cuts, lambda k: F.struct(k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.lit(at) - k).alias("r")))
        phrases = phrases.select("lang", "phrase", F.col("f").alias("a"), parts.alias("parts"))
        candidates = phrases if candidates is None else candidates.unionByName(phrases)
    scored = candidates.join(totals, "lang").withColumn(
        "best",
        F.expr(
            f"array_min(transform(parts, c -> struct(CAST(1000 * CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) AS {EXACT})"
            f" div CAST(CAST(c.l AS decimal(19,0)) * CAST(c.r AS decimal(19,0)) AS {EXACT}) AS score, c.k AS k, c.l AS l, c.r AS r)))"
        ),
    ).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if limit is not None:
        # The first of each of many parts of a language, then of those: no task sorts a whole language.
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        scored = salted.withColumn("rank", place).where(F.col("rank") <= limit).drop("salt", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
