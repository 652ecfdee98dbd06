"""Versioned snapshots with a log of changes on top.

Layout below ``root``::

    data/<uuid>/server_key=<site>/part-*.parquet   a full refresh, a compaction or the changes of a step
    meta/<site>-<number>.json                      one row per site and published step

Data is written to a folder of its own first, then a meta row that names the folder makes it visible. So a
reader never sees half a step, and an attempt that failed leaves nothing a later one could mistake for its own. A
change costs as much as the changed keys, not as much as the snapshot: readers add the changes of a
version to its rows, and ``compact`` folds them into a new version.

The steps of a site are numbered, over all its versions. A step is published by renaming its row to the name of
the next number, which fails if that name is taken: of two writers that start from the same state one succeeds. The other one starts
again from the new state: a full refresh or a compaction by itself, a change by raising ``Conflict``, since what it
would add may be there by now. This needs a file system whose rename refuses an existing target, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime, timezone
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger import schemas
from stockledger.params import TimeLike, as_day, as_moment
from stockledger.plans.delta import apply_delta, matched
from stockledger.plans.snapshot import STOCK
from stockledger.session import file_system

META = {
    "server_key": "string",
    "number": "bigint",
    "version": "bigint",
    "step": "bigint",
    "kind": "string",
    "batch_id": "string",
    "folder": "string",
    "tanggal": "date",
    "closing_ts": "timestamp_ntz",
    "last_refresh": "timestamp_ntz",
    "feed": "string",
    "covered_until": "timestamp_ntz",
    "row_count": "bigint",
    "delta_rows": "bigint",
    "updated_keys": "bigint",
    "published_at": "timestamp_ntz",
}
DELTA = {
    "server_key": "string",
    "kd_divisi": "string",
    "kd_barang": "string",
    "delta_stok": "decimal(38,4)",
}

# Steps of one site and version after which a change also folds them together.
COMPACT_AFTER = 64
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has published a step of the site meanwhile."""


def _escaped(key: str) -> str:
    """A site as Spark writes it into the name of a partition folder."""
    special = "\"#%'*/:=?\\\x7f{[]^"
    return "".join(f"%{ord(c):02X}" if c in special or ord(c) < 32 else c for c in key)


def _rename(spark: SparkSession, context, source, target) -> None:
    """Rename that fails where the target exists."""
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    context.rename(source, target, options)


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- paths and meta ----------------------------------------------------

    def _path(self, folder: str) -> str:
        return f"{self.root}/data/{folder}"

    def _write(self, rows: DataFrame, one_site: bool) -> str:
        """Write rows to a fresh folder, sorted by item within each file so that a search skips row groups and pages.

        The rows of one site are written by the tasks that make them: nothing is dealt anew, and the rows are written once. Those of
        several are dealt by ranges, as otherwise each task would write a file for every site. That reads the rows twice, for a sample
        first, so they are written as they come before: what they are made of is computed once, and the sample reads two columns of files.
        """
        folder, by_item = uuid.uuid4().hex, ["server_key", "kd_barang"]
        made, unsorted = rows, None
        if not one_site:
            unsorted = self._path(f"_{folder}")
            rows.write.parquet(unsorted)
            made = self.spark.read.schema(rows.schema).parquet(unsorted).repartitionByRange(*by_item)
        ordered = made.sortWithinPartitions(*by_item)
        ordered.write.option("partitionOverwriteMode", "static").partitionBy("server_key").parquet(self._path(folder))
        if unsorted is not None:
            files, path = file_system(self.spark, unsorted)
            files.delete(path, True)
        return folder

    def _read(self, pairs: Sequence[tuple[str, str]], columns: dict[str, str]) -> DataFrame:
        """Rows of (site, folder) pairs as one relation, whatever their number; the site is read off the path where there are several."""
        wanted = schemas.ddl({c: t for c, t in columns.items() if c != "server_key"})
        paths = sorted(f"{self._path(folder)}/server_key={_escaped(key)}" for key, folder in pairs)
        if not paths:
            return schemas.empty(self.spark, columns)
        # Worked out for every row, so by plain searches; only a name with escaped characters is decoded.
        named = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/server_key=", -1), "/", 1)
        # The path may be escaped once more, as a URI; a plus sign stands for itself.
        decoded = F.url_decode(F.url_decode(F.replace(named, F.lit("+"), F.lit("%252B"))))
        plain = F.when(F.contains(named, F.lit("%")), decoded).otherwise(named)
        rows, sites = self.spark.read.schema(wanted).parquet(*paths), {key for key, _ in pairs}
        site = F.lit(next(iter(sites))) if len(sites) == 1 else plain  # The paths of one site need no reading.
        return rows.withColumn("server_key", site).select(*columns)

    def _written(self, folder: str, columns: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(schemas.ddl(columns)).parquet(self._path(folder))

    def _counts(self, rows: DataFrame) -> dict[str, int]:
        return {r.server_key: r["count"] for r in rows.groupBy("server_key").count().collect()}

    def meta(self) -> DataFrame:
        """All published steps; empty before the first."""
        files, path = file_system(self.spark, f"{self.root}/meta")
        if not files.exists(path):
            return schemas.empty(self.spark, META)
        return self.spark.read.schema(schemas.ddl(META)).json(f"{self.root}/meta")

    def info(self) -> DataFrame:
        """Latest step of each site, with the refresh moment, as-of day and row count."""
        latest = F.max_by(F.struct(*META), "number").alias("m")
        return self.meta().groupBy("server_key").agg(latest).select("m.*")

    def state(self, server_key: str) -> dict | None:
        """Latest step of a site; None before its first refresh."""
        row = self.info().where(F.col("server_key") == server_key).first()
        return row.asDict() if row else None

    def states(self, batch_id: str | None = None) -> dict[str, dict]:
        """Latest step per site, in one pass over the meta rows; one small row for each site.

        With a batch, ``applied`` says whether the site's current version holds it.
        """
        latest = F.max_by(F.struct(*META), "number").alias("m")
        holding = F.collect_set(F.when(F.col("batch_id") == F.lit(batch_id), F.col("version"))).alias("holding")
        sites = self.meta().groupBy("server_key").agg(latest, holding)
        applied = F.array_contains("holding", F.col("m.version")).alias("applied")
        return {row.server_key: row.asDict() for row in sites.select("m.*", applied).collect()}

    def _publish(self, row: dict) -> None:
        """Make a step visible, as the one after the state it was made from; ``Conflict`` if that is no longer the latest."""
        stamped = {**row, "published_at": datetime.now(timezone.utc).replace(tzinfo=None)}
        text = json.dumps({c: v.isoformat() if isinstance(v, date) else v for c, v in stamped.items() if c in META})
        files, folder = file_system(self.spark, f"{self.root}/meta")
        files.mkdirs(folder)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        ready = hadoop.Path(folder, f"_{uuid.uuid4().hex}")  # Readers pass over names with an underscore.
        out = files.create(ready, False)
        out.write(bytearray(text.encode()))
        out.close()
        name = f"{quote(row['server_key'], safe='')}-{row['number']:012d}.json"
        context = hadoop.FileContext.getFileContext(folder.toUri() if folder.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            _rename(self.spark, context, ready, hadoop.Path(folder, name))
        except Py4JJavaError as problem:
            files.delete(ready, False)
            if "FileAlreadyExists" not in str(problem.java_exception):
                raise
            raise Conflict(f"step {row['number']} of {row['server_key']} is published") from None

    def last_refresh(self, server_key: str) -> datetime | None:
        state = self.state(server_key)
        return state["last_refresh"] if state else None

    def as_of(self, server_key: str) -> date | None:
        state = self.state(server_key)
        return state["tanggal"] if state else None

    def needs_full_refresh(self, server_key: str) -> bool:
        """No snapshot of the site, or one without a refresh moment to start from."""
        return self.last_refresh(server_key) is None

    # ---- full refresh ------------------------------------------------------

    def publish(
        self,
        snapshot: DataFrame,
        tanggal: TimeLike,
        last_refresh: TimeLike,
        closing_ts: TimeLike | None = None,
        server_keys: list[str] | None = None,
    ) -> dict[str, int]:
        """Replace the snapshot of the named sites, by default those ``snapshot`` has rows of; the new version of each.

        A named site without rows gets an empty snapshot. ``last_refresh`` is the moment up to which ingested documents
        were read. It has to be taken before the read, so that documents arriving meanwhile come with
        the next delta. It must not lie before what a stream has put into the site's current version: those documents would be lost.
        """
        until, states = as_moment(last_refresh), self.states()
        self._not_before_streams(states, server_keys, until)
        rows = snapshot.select(*schemas.SNAPSHOT)
        if server_keys is not None:
            rows = rows.where(F.col("server_key").isin(server_keys))
        folder = self._write(rows, server_keys is not None and len(server_keys) == 1)
        counts = self._counts(self._written(folder, schemas.SNAPSHOT))
        versions = {}
        for key in counts if server_keys is None else server_keys:
            step = {
                "server_key": key,
                "step": 0,
                "kind": "full",
                "folder": folder,
                "tanggal": as_day(tanggal),
                "closing_ts": None if closing_ts is None else as_moment(closing_ts),
                "last_refresh": until,
                "row_count": counts.get(key, 0),
                "delta_rows": 0,
                "updated_keys": 0,
            }
            versions[key] = self._new_version(step, states.get(key), server_keys, until)
        return versions

    @staticmethod
    def _not_before_streams(states: dict[str, dict], server_keys: list[str] | None, until: datetime) -> None:
        for key in server_keys or ():
            covered = states.get(key, {}).get("covered_until")
            if covered is not None and covered > until:
                raise ValueError(f"a stream has read {key} up to {covered}; refresh up to a later moment")

    def _new_version(self, step: dict, state: dict | None, server_keys: list[str] | None, until: datetime) -> int:
        """Publish rows that need no earlier state; where another writer was first, after what that one has published."""
        for _ in range(ATTEMPTS):
            state = state or {"number": 0, "version": 0}
            version = state["version"] + 1
            try:
                self._publish({**step, "number": state["number"] + 1, "version": version})
                return version
            except Conflict:
                state = self.state(step["server_key"])
                self._not_before_streams({step["server_key"]: state}, server_keys and [step["server_key"]], until)
        raise Conflict(f"{step['server_key']} is published to all the time")

    # ---- changes -----------------------------------------------------------

    def is_applied(self, server_key: str, batch_id: str) -> bool:
        """Whether the site's current version holds the batch."""
        return bool(self.states(batch_id).get(server_key, {}).get("applied"))

    def append_delta(
        self,
        server_keys: list[str],
        delta: DataFrame | None,
        batch_id: str,
        last_refresh: TimeLike | None,
        delta_rows: int | Callable[[str], int] = 0,
        feed: str = "batch",
        covered_until: Callable[[str], datetime | None] | None = None,
        states: dict[str, dict] | None = None,
    ) -> list[str]:
        """Add net changes per key to the current version of the named sites; the sites they were added to.

        A site whose current version holds the batch is passed over, so a step may be repeated. Without changes only the
        refresh moment moves. Keys the snapshot lacks have no effect. A version takes changes of one feed only, be it batch
        deltas or one stream: two feeds could bring the same document. ``delta_rows`` and ``covered_until`` may be functions
        of the site, called after the changes are written and before they are published, for what is observed meanwhile.
        ``states`` are those the changes were made from, ``self.states(batch_id)``; read here if not given. Where one of them is no longer
        the latest, ``Conflict`` is raised for that site; sites before it have been added to.
        """
        states = self.states(batch_id) if states is None else states
        unknown = [key for key in server_keys if key not in states]
        if unknown:
            raise LookupError(f"no snapshot of {', '.join(unknown)}; refresh in full first")
        keys = [key for key in server_keys if not states[key]["applied"]]
        if not keys:
            return []
        for key in keys:
            if states[key]["feed"] not in (None, feed):
                raise ValueError(f"{key} takes changes of {states[key]['feed']}, not of {feed}; refresh in full first")
        folder, changed = None, {}
        if delta is not None:
            rows = delta.where(F.col("server_key").isin(keys))
            folder = self._write(rows.select(*[F.col(c).cast(t).alias(c) for c, t in DELTA.items()]), len(keys) == 1)
            # Keys the snapshot lacks are written too, but no reader takes them.
            written = self._written(folder, DELTA)
            changed = {} if written.isEmpty() else self._counts(matched(self._bases(keys), written))
        rows = []
        for key in keys:
            state, covered = states[key], covered_until(key) if covered_until else None
            moments = [m for m in (state["covered_until"], covered) if m is not None]
            rows.append(
                {
                    **state,
                    "number": state["number"] + 1,
                    "step": state["step"] + 1,
                    "kind": "delta",
                    "batch_id": batch_id,
                    "folder": folder,
                    "last_refresh": state["last_refresh"] if last_refresh is None else as_moment(last_refresh),
                    "feed": feed,
                    "covered_until": max(moments, default=None),
                    "delta_rows": delta_rows(key) if callable(delta_rows) else delta_rows,
                    "updated_keys": changed.get(key, 0),
                }
            )
        for row in rows:
            self._publish(row)
            if row["step"] % COMPACT_AFTER == 0:
                self.compact(row["server_key"])
        return keys

    # ---- reading -----------------------------------------------------------

    def _folders(self, server_key: str | None = None) -> list:
        """One row for each site: its current version's snapshot folder and the folders of its changes."""
        steps = self.meta() if server_key is None else self.meta().where(F.col("server_key") == server_key)
        is_change = F.col("kind") == "delta"
        changes = F.collect_set(F.when(is_change & (F.col("updated_keys") > 0), F.col("folder")))
        base = F.max_by(F.when(F.col("row_count") > 0, F.col("folder")), F.when(~is_change, F.col("number")))
        by_version = steps.groupBy("server_key", "version").agg(base.alias("base"), changes.alias("changes"))
        newest = F.max_by(F.struct("server_key", "base", "changes"), "version").alias("n")
        return by_version.groupBy("server_key").agg(newest).select("n.*").collect()

    def _bases(self, keys: Iterable[str]) -> DataFrame:
        """Snapshot rows, without changes, of the sites' current versions."""
        return self._base_rows([r for r in self._folders() if r.server_key in set(keys)])

    def _base_rows(self, sites: list) -> DataFrame:
        return self._read([(r.server_key, r.base) for r in sites if r.base is not None], schemas.SNAPSHOT)

    def read(self, server_key: str | None = None) -> DataFrame:
        """Current snapshot of one site or of all, changes included."""
        current = self._folders(server_key)
        if not current:
            raise LookupError(f"no snapshot of {server_key or 'any site'}; refresh first")
        base = self._base_rows(current)
        log = [(r.server_key, folder) for r in current for folder in r.changes]
        if not log:
            return base
        changes = self._read(log, DELTA).groupBy(*STOCK).agg(F.sum("delta_stok").alias("delta_stok"))
        return apply_delta(base, changes)

    def compact(self, server_key: str) -> int:
        """Fold the changes of a site into a new version that keeps its day, moments and feed."""
        for _ in range(ATTEMPTS):
            state = self.state(server_key)
            if state is None:
                raise LookupError(f"no snapshot of {server_key}; refresh first")
            folder = self._write(self.read(server_key), True)
            version = state["version"] + 1
            # The last batch stays known, so that a stream that repeats it changes nothing.
            fresh = {"version": version, "step": 0, "kind": "compact", "folder": folder, "delta_rows": 0, "updated_keys": 0}
            try:
                self._publish({**state, **fresh, "number": state["number"] + 1})
                return version
            except Conflict:
                continue  # What was published meanwhile has to be folded in too.
        raise Conflict(f"{server_key} is published to all the time")

    def remove(self) -> None:
        """Delete the store and all it holds."""
        files, path = file_system(self.spark, self.root)
        files.delete(path, True)
