"""Quality rules with thresholds from the data: one quantile sketch for each language and source.

Each measure of a text (mean word length, shares of symbols, of repeated lines and of repeated words) is held against the
quartiles of its own language and source: it is out of range beyond ``SPREAD`` quartile ranges, plus
a fixed slack that keeps the rule from biting where all texts of a source are alike.
The quartiles come from Spark's quantile summaries, which are made for each task and merged. Groups of fewer than
``LEAST`` texts use their language's thresholds, or else those of all texts. Two rules stay fixed, as floors:
texts under 50 words, and texts of which more than half of the words lie in repeated three-word windows.

Nulls and empty texts have no words and fail the fixed rules; null languages and sources are groups of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import fresh, record, runs, written
from stockledger.llm.textstats import IS_SYMBOL, TextRun

SPREAD = 3.0
LEAST = 200
ACCURACY = 10_000

#: Measure: slack below (None: no lower bound) and above.
MEASURES = {
    "mean_word_chars": (1.0, 1.0),
    "symbol_share": (None, 0.03),
    "dup_line_share": (None, 0.2),
    "repeat_share": (None, 0.2),
}

COUNTS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    + [("lang", pa.string()), ("source", pa.string())]
)


def text_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Counts of each text with its group: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, lang, source."""

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in runs(iter([batch])):
                text = TextRun(texts)
                lines, duplicates = text.duplicate_lines()
                yield record(
                    COUNTS, ids, text.n_words(), text.word_chars(), text.total(IS_SYMBOL), lines, duplicates,
                    text.repeated_words(), batch.column(2).slice(at, len(ids)), batch.column(3).slice(at, len(ids)),
                )
                at += len(ids)

    columns = [F.col(id_col).cast("long"), *(F.col(c).cast("string") for c in (text_col, lang_col, source_col))]
    frame = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    longs = ", ".join(f"{f.name} long" for f in COUNTS if pa.types.is_int64(f.type))
    return frame.mapInArrow(run, f"{longs}, lang string, source string")


def measures(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """A row for each (lang, source) that occurs: ``low_m`` and ``high_m`` of each measure m, and the texts they rest on.

    Sketches are merged for the group, for its language and for everything; the first with enough texts counts.
    """
    quartiles = [F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(m) for m in MEASURES]
    sketches = (
        measured.where(~F.col("base_failed"))
        .rollup("lang", "source")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *quartiles)
    )
    sketches = written(sketches, "sketches")
    group = lambda level, names: sketches.where(F.col("level") == level).select(
        *(F.col(c).alias(f"{c}_{level}") for c in names), F.struct("n", *MEASURES).alias(f"at_{level}")
    )
    overall = sketches.where("level = 3").select("n", *MEASURES).first()
    fields = [F.lit(overall.n if overall else 0).cast("long").alias("n")]
    for m in MEASURES:
        ends = (overall[m] if overall else None) or (None, None)
        fields.append(F.array(*(F.lit(x).cast("double") for x in ends)).alias(m))
    groups = measured.select("lang", "source").distinct()
    found = groups.join(group(0, ["lang", "source"]), F.expr("lang <=> lang_0 AND source <=> source_0"), "left").join(
        group(1, ["lang"]), F.expr("lang <=> lang_1"), "left"
    )
    chosen = F.coalesce(*(F.when(F.col(f"at_{k}.n") >= LEAST, F.col(f"at_{k}")) for k in (0, 1)), F.struct(*fields))
    found = found.select("lang", "source", chosen.alias("at"))

    def bound(name: str, slack: float, sign: int) -> Column:
        low, high = F.col(f"at.{name}")[0], F.col(f"at.{name}")[1]
        return (high if sign > 0 else low) + sign * (SPREAD * (high - low) + slack)

    bounds = [bound(m, b, 1).alias(f"high_{m}") for m, (_, b) in MEASURES.items()]
    bounds += [bound(m, a, -1).alias(f"low_{m}") for m, (a, _) in MEASURES.items() if a is not None]
    return found.select("lang", "source", F.col("at.n").alias("n_texts"), *bounds)


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` of each document; one row for each row of ``docs``."""
    counts = written(text_counts(docs, id_col, text_col, lang_col, source_col), "counts")
    measured = measures(counts)
    own = measured.alias("d").join(
        thresholds(measured).alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left"
    )
    inside = F.lit(True)
    for m, (low, _) in MEASURES.items():
        inside = inside & (F.col(m) <= F.coalesce(f"high_{m}", F.col(m)))
        if low is not None:
            inside = inside & (F.col(m) >= F.coalesce(f"low_{m}", F.col(m)))
    return own.select("d.*", (~F.col("base_failed") & inside).alias("kept"))


def filtered(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Rows of ``docs``, all columns, that are kept; matched by id, which should be unique and not null."""
    of = fresh("of")
    kept = judged(docs, id_col, **columns).where("kept").select(F.col("doc_id").alias(of))
    return docs.join(written(kept, "kept"), docs[id_col] == F.col(of), "left_semi")

