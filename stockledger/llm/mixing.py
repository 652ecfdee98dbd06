"""Mixing sources to target weights, with DataFrame functions only.

The words of all documents (or ``budget`` words) are shared out over the sources by weight. No source gives more than
``max_epochs`` times its own words; what it cannot give goes to the others by weight, until nobody is above that.

Every document has a random key, a hash of its id and text. Within a source the documents are sorted by that key: the keys are uniform, so
ranges of equal width hold equally many documents, and a row goes to its (source, range) without a sample of the keys. Words are
summed for each range, the sums are added up along the ranges of a source, and the rows of a range continue from there: prefix sums of which
no task sees more than a range. A source that makes up a third of all rows has a third of the ranges' rows, not a task of its own.

A source gives as many whole epochs as fit in its target and then, in the order of the keys, documents up to the target's
last whole word; the document that lies across the cut gives its first words only. So a source gives exactly the whole part of its target.

Null and empty texts have no words and are never taken. A null source is a source of its own, after all others. Rows without an id and rows with
equal ids are documents of their own; rows equal in id and text are interchangeable. A table without words has targets of 0.
Columns of the input named like a result (size, source_size, target, taken, copies, start) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockledger.llm.common import written

SPACES = r"\x20\x09-\x0D"
CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
KEY_BITS = 60
RANGE_ROWS = 10_000
EXACT = "decimal(38,0)"
RESULTS = ("size", "source_size", "target", "taken", "copies", "start")


def n_words(text):
    """Words of a text: each is made one letter with the space behind it, so that no list of words is held."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, f"[^{SPACES}]++[{SPACES}]*+", "x")).cast("long")


def keyed(docs: DataFrame, carried: Sequence[str], id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """One row for each document: its source as a text that is never null, its size, its key and the carried columns."""
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    digest = F.md5(F.concat(F.lit(seed), identity, F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("part"),
        n_words(text).alias("size"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        identity.alias("identity"),
        F.struct(*carried).alias("row"),
    )


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... of the sources by code point, null last. One row a source goes through this window."""
    rank = F.row_number().over(Window.orderBy(F.col("part") == "", "part")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int")))


def targets(sources: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source, from ``part``, ``source_size`` and a whole ``weight``; adds ``target``, ``words``, ``epochs`` and ``rest``.

    In the order of limit by weight, a source is at its limit if the share it would get of what the ones before it leave is above.
    All sums are exact; one row a source goes through these windows.
    """
    order = Window.orderBy(F.try_divide(F.col("limit").cast("double"), F.col("weight")).asc_nulls_last(), "part")
    everything = Window.partitionBy()
    exact = sources.select(
        "part",
        "source_size",
        F.col("weight").cast("decimal(18,0)").alias("weight"),
        (F.col("source_size") * max_epochs).cast("decimal(20,0)").alias("limit"),
    )
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(everything)
    shared = exact.withColumns(
        {
            "total": total.cast("decimal(20,0)"),
            "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)"),
            "weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(18,0)"),
        }
    )
    full = F.col("limit") * F.col("weights") < F.col("weight") * (F.col("total") - F.col("before")).cast("decimal(20,0)")
    shared = shared.withColumn("full", full).withColumns(
        {
            "left": (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))).cast("decimal(20,0)"),
            "open": F.nullif(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything).cast("decimal(18,0)"), F.lit(0)),
        }
    )
    share = (F.col("weight") * F.col("left")).cast(EXACT)
    whole = F.expr(f"CAST(weight * left AS {EXACT}) div open")
    words = F.when(F.col("full"), F.col("limit")).otherwise(F.coalesce(whole, F.lit(0))).cast("long")
    part = F.coalesce(F.try_divide(share.cast("double"), F.col("open").cast("double")), F.lit(0.0))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(part)
    return shared.select("part", "source_size", target.alias("target"), words.alias("words")).withColumns(
        {
            "epochs": F.coalesce(F.expr("words div nullif(source_size, 0)"), F.lit(0)),
            "rest": F.coalesce(F.expr("words % nullif(source_size, 0)"), F.lit(0)),
        }
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    budget: int | None = None,
    max_epochs: int = MAX_EPOCHS,
    carried: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "",
) -> DataFrame:
    """Every document with what the mix takes of it.

    weights    (source, weight), whole numbers; sources it lacks or gives less weigh 0. None: 1, 2, 3 repeating
    carried    columns of ``docs`` to keep; all of them if None

    Adds ``size`` (words), ``source_size``, ``target`` (words wanted of its source), ``taken`` (words taken, repeats counted), ``copies``
    (times it is in the mix, the last time perhaps in part) and ``start`` (words of its source before it).
    """
    carried = list(docs.columns if carried is None else carried)
    rows = written(keyed(docs, carried, id_col, text_col, source_col, seed), "keyed")
    bits = max(8, min(30, (rows.count() // RANGE_ROWS).bit_length()))
    rows = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    ranges = written(rows.groupBy("part", "range").agg(F.sum("size").alias("words_here")), "ranges")
    sources = ranges.groupBy("part").agg(F.sum("words_here").alias("source_size"))
    if weights is None:
        sources = cycled_weights(sources)
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("part"), "weight")
        sources = sources.join(given, "part", "left").withColumn("weight", F.greatest("weight", F.lit(0)))
    wanted = written(targets(sources, budget, max_epochs), "targets")
    earlier = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_range", F.coalesce(F.sum("words_here").over(earlier), F.lit(0))).drop("words_here")
    within = Window.partitionBy("part", "range").orderBy("key", "identity", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges.join(wanted, "part"), ["part", "range"]).withColumn(
        "start", F.col("before_range") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    last = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", F.col("epochs") * F.col("size") + last)
    copies = F.coalesce(F.expr("(taken + size - 1) div nullif(size, 0)"), F.lit(0)).cast("int").alias("copies")
    kept = [F.col(f"row.`{c}`").alias(c) for c in carried if c not in RESULTS]
    return placed.select(*kept, "size", "source_size", "target", "taken", copies, "start")


def mixture(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``epoch`` (from 1), one row each time a document is in it.

    A document that lies across the cut keeps the space between its first words as it is and ends after the last one.
    """
    mixed = mix(docs, text_col=text_col, **how).where("taken > 0")
    each = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[{SPACES}]*[^{SPACES}]+"), F.lit(0))
    text = F.when(words < F.col("size"), F.array_join(F.slice(pieces, 1, words), "")).otherwise(F.col(text_col))
    kept = [c for c in docs.columns if c not in (*RESULTS, "epoch")]
    return each.withColumn(text_col, text).select(*kept, "epoch")
