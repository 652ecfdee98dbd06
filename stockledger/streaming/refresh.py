"""Refreshing a stored snapshot: in full, by a batch delta, or from a stream.

Late documents need no event-time watermark: a document counts however late it arrives
while its date lies between the closing and the as-of day, and a snapshot holds one
number per division and item, not per moment. What counts is when it reached the server:
the base of a version holds all documents up to its refresh moment, its changes only later ones.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockledger.operators.movements import DELTA_POLICY
from stockledger.params import LedgerWindow, TimeLike, as_day, as_moment
from stockledger.plans.delta import DELTA, accumulate, delta_movements, delta_rows
from stockledger.plans.snapshot import stock_snapshot
from stockledger.sinks.snapshot_store import ATTEMPTS, Conflict, SnapshotStore
from stockledger.sources.base import Source
from stockledger.streaming.documents import state_on_disk

# Columns of lines and headers that a refresh adds up, or adds up by.
ADDED_UP = frozenset({"kd_barang", "qty", "kd_satuan", "kd_divisi", "kd_divisi_asal", "kd_divisi_tujuan", "tanggal_server"})


def full_refresh(
    store: SnapshotStore,
    source: Source,
    window: LedgerWindow,
    known_until: TimeLike,
    server_keys: list[str] | None = None,
) -> dict[str, int]:
    """Publish the snapshot of all documents ingested by ``known_until``, of the named sites or all with rows."""
    snapshot = stock_snapshot(source, window.known_at(known_until))
    if server_keys is None and source.server_key is not None:
        server_keys = [source.server_key]
    return store.publish(snapshot, window.as_of, known_until, window.closing_ts, server_keys)


def delta_refresh(
    store: SnapshotStore,
    source: Source,
    window: LedgerWindow,
    known_until: TimeLike,
    server_key: str = "main",
) -> str:
    """Add what was ingested between the stored refresh moment and ``known_until``.

    Falls back to a full refresh where there is no snapshot to start from; where its as-of
    day or its closing is another one, as documents ingested before may belong to the other window only; and
    where a stream has added to it, as the documents the stream brought cannot be told from those of
    a delta. The upper bound is fixed before the read, so nothing that arrives meanwhile is skipped. Says what was done:
    "full", "delta", or "unchanged" where there was nothing to add.
    """
    for _ in range(ATTEMPTS):
        try:
            return _delta_refresh(store, source, window, known_until, server_key)
        except Conflict:
            continue  # Another refresh was first: begin again where it has left off.
    raise Conflict(f"{server_key} is refreshed all the time")


def _delta_refresh(store: SnapshotStore, source: Source, window: LedgerWindow, known_until: TimeLike, server_key: str) -> str:
    state = store.state(server_key)
    same = (
        state is not None
        and state["last_refresh"] is not None
        and state["tanggal"] == as_day(window.as_of)
        and state["closing_ts"] == as_moment(window.closing_ts)
        and state["feed"] in (None, "batch")
    )
    if not same:
        full_refresh(store, source, window, known_until, [server_key])
        return "full"
    since = state["last_refresh"]
    if as_moment(known_until) <= since:
        return "unchanged"
    bounded = LedgerWindow(window.closing_ts, window.as_of, since, known_until)
    rows = delta_rows(source, bounded).where(F.col("server_key") == server_key)
    batch = f"batch-{since:%Y%m%dT%H%M%S%f}-{as_moment(known_until):%Y%m%dT%H%M%S%f}"
    seen, states = _Seen(rows, [server_key]), {server_key: {**state, "applied": state["batch_id"] == batch}}
    added = store.append_delta(
        [server_key], accumulate(seen.rows, source), batch, known_until, seen.count, states=states
    )
    return "delta" if added and seen.count(server_key) else "unchanged"


class _Seen:
    """What a feed brings for each site, observed while the feed is summed up: no pass of its own."""

    def __init__(self, rows: DataFrame, server_keys: Sequence[str], newer: Column | None = None):
        self.numbers = {key: i for i, key in enumerate(server_keys)}
        self.observed, newer = Observation(), F.lit(True) if newer is None else newer
        known = F.col("server_key").isin(list(server_keys))
        sums = [F.count(F.when(~F.coalesce(known, F.lit(False)), 1)).alias("strange")]
        for key, i in self.numbers.items():
            mine = F.col("server_key") == key
            sums.append(F.count(F.when(mine & newer, 1)).alias(f"n{i}"))
            if "tanggal_server" in rows.columns:
                sums.append(F.max(F.when(mine, F.col("tanggal_server"))).alias(f"until{i}"))
        self.rows = rows.observe(self.observed, *sums).where(newer)

    def _value(self, name: str):
        """An observed value; None where Spark left the feed out of the plan because it has no rows.

        Nothing is observed then, which Spark reports as a failed assertion. Anything else is a failure here too.
        """
        try:
            return self.observed.get.get(name)
        except Py4JJavaError as problem:
            if problem.java_exception.getClass().getName() != "java.lang.AssertionError":
                raise
            return None

    def count(self, server_key: str) -> int:
        if self._value("strange"):
            raise LookupError(f"the feed has rows of other sites than {', '.join(self.numbers)}")
        return self._value(f"n{self.numbers[server_key]}") or 0

    def until(self, server_key: str):
        return self._value(f"until{self.numbers[server_key]}")


def stream_refresh(
    store: SnapshotStore,
    feed: Source,
    lookup: Source,
    window: LedgerWindow,
    checkpoint: str,
    server_keys: list[str],
    kinds: Sequence[str],
) -> StreamingQuery:
    """Keep the snapshot up to date from a stream of document lines.

    ``feed`` is a source with streaming line tables and header tables, ``kinds`` the header tables of the
    kinds of document to follow; each must be a kind of a delta, and its lines must stream. ``lookup`` gives the unit
    factors. All available lines are processed in micro-batches, then the query stops; the checkpoint remembers
    what was read, and its id and the batch's number tell whether a batch was added before.

    Headers may be tables or streams. A line is joined with a header table as it is when the line's batch runs, so headers have to arrive before
    their lines. With streams of both, either may come first: they wait for each other as the state of the query, by site and document number, for
    good or for as long as ``feed.wait`` says. Only headers ingested after the window's bound are read. Rows up to the refresh moment of their site's base are
    passed over, so a full refresh between two runs counts nothing twice. All sites need a snapshot, and a row of
    a site that is not named is an error. The state of all sites is read once a batch.
    """
    known = {branch.table: branch for branch in DELTA_POLICY.branches}
    odd = [k for k in kinds if k not in known or not feed.table(f"{k}_detail").isStreaming]
    if odd or not kinds:
        raise ValueError(f"no streams of lines: {', '.join(odd) or 'no kinds given'}")
    absent = sorted(set(server_keys) - set(store.states()))
    if absent:
        raise LookupError(f"no snapshot of {', '.join(absent)}; refresh in full first")
    spark = store.spark
    policy = DELTA_POLICY.only(*[b for b in DELTA_POLICY.branches if b.table in kinds])
    # What a refresh does not add up has no place in the state of a stream of headers either.
    feed = copy.copy(feed)
    feed.carried = ADDED_UP
    rows = delta_movements(feed, window, policy).withColumnRenamed("sumber", "source").select(*DELTA, "tanggal_server")

    def apply(batch: DataFrame, batch_id: int) -> None:
        found = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value
        name = f"stream-{json.loads(found)['id']}"
        step = f"{name}-{batch_id}"
        states = store.states(step)
        open_keys = [k for k in server_keys if not states[k]["applied"]]
        if not open_keys:
            return
        # One small row for each site. Sites that hold the batch already are followed too, but have no newer rows.
        moments = spark.createDataFrame([(k, states[k]["last_refresh"]) for k in open_keys], "server_key string, __since timestamp_ntz")
        dated = batch.join(F.broadcast(moments), "server_key", "left")
        newer = F.coalesce(F.col("tanggal_server") > F.col("__since"), F.lit(False))
        seen = _Seen(dated, server_keys, newer)
        store.append_delta(open_keys, accumulate(seen.rows, lookup), step, None, seen.count, name, seen.until, states)

    with state_on_disk(spark):
        return (
            rows.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
