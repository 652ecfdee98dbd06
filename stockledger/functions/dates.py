"""Day and moment comparisons on ``timestamp_ntz`` columns.

Bounds are literals of the column's own type compared with the bare column, so each
of them reaches the parquet scan as a pushed filter.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockledger.params import LedgerWindow, TimeLike, as_day, as_moment



def moment(value: TimeLike) -> Column:
    return F.lit(as_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day_start(value: TimeLike) -> Column:
    return moment(as_day(value))


def day_after(value: TimeLike) -> Column:
    return moment(as_day(value) + timedelta(days=1))


def in_window(tanggal: Column, window: LedgerWindow) -> Column:
    """After the closing moment, and by the end of the as-of day when one is set."""
    inside = tanggal > moment(window.closing_ts)
    if window.as_of is not None:
        inside = inside & (tanggal < day_after(window.as_of))
    return inside


def in_days(tanggal: Column, first: TimeLike, last: TimeLike) -> Column:
    """Both days included, whatever the time of day."""
    return (tanggal >= day_start(first)) & (tanggal < day_after(last))


def ingest_bounds(tanggal_server: Column, window: LedgerWindow) -> Column | None:
    """A document without an ingest time is never news, so it belongs to the base."""
    bounds = None
    if window.ingested_after is not None:
        bounds = tanggal_server > moment(window.ingested_after)
    if window.ingested_until is not None:
        until = tanggal_server <= moment(window.ingested_until)
        bounds = (until | tanggal_server.isNull()) if bounds is None else bounds & until
    return bounds


def day_range(tanggal: Column, start: TimeLike | None, end: TimeLike | None) -> Column | None:
    """Day filter of a history; a row without a date passes only when no bound is given."""
    bounds = None
    if start:
        bounds = tanggal >= day_start(start)
    if end:
        before = tanggal < day_after(end)
        bounds = before if bounds is None else bounds & before
    return bounds


def as_text(tanggal: Column) -> Column:
    return F.date_format(tanggal, "yyyy-MM-dd HH:mm:ss")
