"""Running totals and ordinals that do not gather a group in one task.

A window over a whole item would put a third of the ledger into one task if one item
made up a third of it. Here the rows of a group are cut, by leading sort keys, into
chunks; only chunks are windowed. What came before a chunk is found from the chunk
totals, level by level: first the totals of the coarsest keys are summed in order, then
those of the next level within them. Totals combine on the map side.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, TimestampNTZType

from stockledger.functions.numbers import RUNNING
from stockledger.operators.sharing import naming, unnamed

COUNT = "__count"
# Ranges of a value, and rows of one value in a chunk.
RANGES = 128
STRETCH = 1 << 16
# Groups beyond this many rows, half of what a shuffle partition of usual size holds, are cut into chunks; counted by
# buckets of their hash, so that few numbers say which.
BUSY = 1 << 18
BUCKETS = 1 << 20


@dataclass(frozen=True)
class Level:
    """A leading sort key, not null, by which the rows of a group are cut into chunks.

    ``blank``, of the type ``kind``, stands for the key in groups that are not cut.
    """

    key: Column
    ascending: bool = True
    kind: str = "string"
    blank: str = ""


def level_names(levels: Sequence[Level]) -> list[str]:
    return [f"__level{i}" for i in range(len(levels))]


def with_levels(rows: DataFrame, levels: Sequence[Level]) -> DataFrame:
    return rows.withColumns({n: v.key for n, v in zip(level_names(levels), levels, strict=True)})


def bucket(group: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*group), F.lit(BUCKETS))


def busy_buckets(keys: DataFrame, group: Sequence[str]) -> list[int]:
    """Buckets of the groups that have more than ``BUSY`` rows in ``keys``, in order; a bucket may hold small groups too.

    At most one for each ``BUSY`` rows. As literals they cut alike in every pass and every task that is run again.
    """
    counts = keys.groupBy(bucket(group).alias("bucket")).count()
    return sorted(r.bucket for r in counts.where(F.col("count") > BUSY).select("bucket").collect())


def _kind(total: str) -> str:
    return "bigint" if total == COUNT else RUNNING


def before_name(total: str) -> str:
    return f"__before{total}"


def totals_before(
    chunks: DataFrame,
    group: Sequence[str],
    levels: Sequence[Level],
    totals: Sequence[str],
    carried: Sequence[str] = (),
) -> DataFrame:
    """Per chunk, the sum of each total over all earlier chunks of its group.

    ``chunks`` has one row for each chunk: the group, the level keys, the totals and the
    columns to be carried along. It is dealt by all keys but the last, for the window over
    the last and for the sums of the next level alike.
    """
    names = level_names(levels)
    outer, last, down = [*group, *names[:-1]], names[-1], not levels[-1].ascending
    if len(levels) > 1:
        chunks = chunks.repartition(*outer)
    earlier = (
        Window.partitionBy(*outer)
        .orderBy(F.col(last).desc() if down else F.col(last).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    here = chunks.select(
        *outer,
        last,
        *carried,
        *[
            F.coalesce(F.sum(t).over(earlier), F.lit(0)).cast(_kind(t)).alias(before_name(t))
            for t in totals
        ],
    )
    if len(levels) == 1:
        return here
    sums = [F.sum(t).cast(_kind(t)).alias(t) for t in totals]
    summed = unnamed(chunks.groupBy(*outer).agg(*sums, naming(last, *carried)))
    above = totals_before(summed, group, levels[:-1], totals).withColumnsRenamed(
        {before_name(t): f"__above{t}" for t in totals}
    )
    both = {t: F.col(before_name(t)) + F.col(f"__above{t}") for t in totals}
    return here.join(above, outer).select(
        *outer,
        last,
        *carried,
        *[column.cast(_kind(t)).alias(before_name(t)) for t, column in both.items()],
    )


def within_chunks(
    rows: DataFrame,
    chunk: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    ordinal: str | None = None,
) -> DataFrame:
    """Cumulative sums, and the ordinal, of rows that carry what came before their chunk.

    The rows of a chunk are taken in ``order``. Sum number i continues the total
    ``__sum<i>``, the ordinal the total ``__count``.
    """
    window = (
        Window.partitionBy(*chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = {
        name: F.sum(F.coalesce(column, F.lit(0))).over(window).cast(RUNNING)
        + F.col(before_name(f"__sum{i}"))
        for i, (name, column) in enumerate(sums.items())
    }
    result = {name: column.cast(RUNNING) for name, column in added.items()}
    if ordinal is not None:
        result[ordinal] = F.row_number().over(window) + F.col(before_name(COUNT))
    kept = [c for c in rows.columns if c not in result and not c.startswith("__")]
    return rows.select(*kept, *[column.alias(name) for name, column in result.items()])


def whole_groups(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    ordinal: str | None = None,
) -> DataFrame:
    """Cumulative sums, and the ordinal, of groups that are small enough to be a chunk each."""
    nothing = [before_name(f"__sum{i}") for i in range(len(sums))] + [before_name(COUNT)]
    zero = {name: F.lit(0).cast(_kind(COUNT if name == before_name(COUNT) else name)) for name in nothing}
    return within_chunks(rows.withColumns(zero), group, order, sums, ordinal)


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    levels: Sequence[Level],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    ordinal: str | None = None,
) -> DataFrame:
    """Add cumulative sums, and a 1-based ordinal, over each group of rows.

    Rows are taken in the order of the level keys, then of ``order``. Group columns must
    not be null. Rows are dealt by chunk once, for their sums and for the windows.
    """
    chunk = [*group, *level_names(levels)]
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in chunk])
    keyed = with_levels(rows, levels).where(present).repartition(*chunk)
    measures = {f"__sum{i}": F.coalesce(column, F.lit(0)) for i, column in enumerate(sums.values())}
    if ordinal is not None:
        measures[COUNT] = F.lit(1)
    totals = [F.sum(column).cast(_kind(t)).alias(t) for t, column in measures.items()]
    chunks = unnamed(keyed.groupBy(*chunk).agg(*totals, naming(*keyed.columns)))
    before = totals_before(chunks, group, levels, list(measures))
    return within_chunks(keyed.join(before, chunk), chunk, order, sums, ordinal)


def _measure(value: Column, kind: DataType, shared: int = 0) -> Column:
    """A double that never falls where the value rises; of a text, seven bytes behind its first ``shared``."""
    if isinstance(kind, StringType):
        digits = F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, 7))
        return F.conv(F.rpad(digits, 14, "0"), 16, 10).cast("double")
    if isinstance(kind, TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return (F.datediff(F.to_date(value), F.lit("1970-01-01").cast("date")) * 86400.0 + seconds).cast("double")
    return value.cast("double")


def range_levels(rows: DataFrame, value: Column, ascending: bool, number: Column) -> list[Level]:
    """Levels that cut rows sorted by any value, nulls last, and then by ``number``, a running number within the group.

    First ranges of the value, between quantiles of all rows from one mergeable sketch; they
    enter the plan as literals, so every pass and every task that is run again cuts alike.
    Then the value itself, and for values that very many rows share, stretches of the number.
    """
    kind = rows.select(value.alias("v")).schema["v"].dataType
    shared = 0
    if isinstance(kind, StringType):
        ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
        shared = len(os.path.commonprefix([(ends.a or "").encode(), (ends.b or "").encode()]))
    measure = _measure(value, kind, shared)
    shares = [i / RANGES for i in range(1, RANGES)]
    found = rows.agg(F.percentile_approx(measure, shares, 20 * RANGES).alias("bounds")).first().bounds
    bounds = sorted(set(found or ()))
    above = reduce(lambda a, b: a + b, [(measure > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    place = above if ascending else F.lit(len(bounds)) - above
    place = F.when(value.isNull(), F.lit(len(bounds) + 1)).otherwise(place)
    blank = {"string": "", "timestamp_ntz": "1970-01-01"}.get(kind.simpleString(), "0")
    present = F.coalesce(value, F.lit(blank).cast(kind))
    return [
        Level(F.coalesce(place, F.lit(0))),
        Level(present, ascending),
        Level(F.coalesce(F.floor(number / STRETCH), F.lit(0))),
    ]
