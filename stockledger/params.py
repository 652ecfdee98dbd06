"""Parameters that select the part of the ledger a product looks at."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime


TimeLike = str | date | datetime


def as_day(value: TimeLike) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.fromisoformat(value).date()


def as_moment(value: TimeLike) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


@dataclass(frozen=True)
class LedgerWindow:
    """Business-date and ingest-date bounds of a ledger read.

    closing_ts      last book closing; transactions at or before it are in the opening stock
    as_of           last business day that counts, None for no upper bound
    ingested_after  keep documents that reached the server after this moment (change feed)
    ingested_until  keep documents that reached the server by this moment (base of a delta)
    """

    closing_ts: str | date | datetime
    as_of: str | date | datetime | None = None
    ingested_after: str | date | datetime | None = None
    ingested_until: str | date | datetime | None = None

    def changed_since(self, moment: str | date | datetime) -> "LedgerWindow":
        return replace(self, ingested_after=moment, ingested_until=None)

    def known_at(self, moment: str | date | datetime) -> "LedgerWindow":
        return replace(self, ingested_after=None, ingested_until=moment)
