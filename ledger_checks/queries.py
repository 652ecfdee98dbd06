"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger import schemas
from stockledger.functions import dates
from stockledger.operators import items, movements, purchases
from stockledger.params import LedgerWindow
from stockledger.plans import costing, delta, history, report, snapshot
from stockledger.session import file_system, reliable_checkpoint, shared_dir
from stockledger.sinks import reports
from stockledger.sinks.snapshot_store import SnapshotStore
from stockledger.sources import FrameSource, ParquetSource, run_statement
from stockledger.sources.testdata import TestdataSource
from stockledger.streaming.refresh import delta_refresh, full_refresh, stream_refresh

# Fixed values of the test mapping.
CLOSING = "1996-12-31 00:00:00"
ORDERS_ONLY = "2000-06-30"
WITH_COUNTS = "2024-01-15"
LAST_REFRESH = "2000-01-01 00:00:00"
END_OF_FEED = "2100-01-01 00:00:00"
AFTER_FEED = "2100-01-02 00:00:00"
HISTORY_ITEMS = ["6", "104", "3"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ORDERS = LedgerWindow(CLOSING, ORDERS_ONLY)
COUNTS = LedgerWindow(CLOSING, WITH_COUNTS)
FEED = ORDERS.changed_since(LAST_REFRESH)
BASE = ORDERS.known_at(LAST_REFRESH)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


_sources: dict[tuple, TestdataSource] = {}


def _source(spark: SparkSession, sf_dir: str, by_region: bool = False) -> TestdataSource:
    """One source per session and folder: its tables are declared once, and read each time."""
    key = (spark, sf_dir, by_region)
    if key not in _sources:
        _sources[key] = TestdataSource(spark, sf_dir, by_region)
    return _sources[key]


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.stock_snapshot(_source(spark, sf_dir), COUNTS)


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 4).cast("double") for n in names})


# ---- sources ---------------------------------------------------------------


@query
def division_scan(spark, sf_dir):
    statement = "SELECT kd_divisi, nama FROM {m_divisi} WHERE keterangan LIKE :region"
    return run_statement(_source(spark, sf_dir), statement, {"region": "A%"})


@query
def unit_scan(spark, sf_dir):
    units = _source(spark, sf_dir).table("m_barang_satuan")
    return units.select("kd_barang", "kd_satuan", F.col("jumlah").cast("double").alias("jumlah"))


# ---- item master and prices ------------------------------------------------


@query
def master_items(spark, sf_dir):
    master = items.item_master(_source(spark, sf_dir))
    return _doubles(master, "harga_jual")


@query
def last_buy_price(spark, sf_dir):
    return _doubles(purchases.last_buy_price(_source(spark, sf_dir)), "harga_beli")


@query
def weighted_avg_price(spark, sf_dir):
    return _doubles(purchases.weighted_average_price(_source(spark, sf_dir)), "harga_avg")


@query
def net_buy_price(spark, sf_dir):
    layers = costing.purchase_layers(_source(spark, sf_dir))
    return layers.select(
        "no_transaksi",
        "line_no",
        "kd_barang",
        dates.as_text(F.col("tanggal")).alias("tanggal"),
        "stok",
        "harga",
    )


@query
def inbound_layers(spark, sf_dir):
    layers = costing.inbound_layers(_source(spark, sf_dir), COUNTS)
    return layers.select(
        "kd_barang",
        dates.as_text(F.col("tanggal")).alias("tanggal"),
        "jenis",
        "stok",
        "harga",
    )


@query
def stock_per_item(spark, sf_dir):
    return _doubles(costing.stock_per_item(_source(spark, sf_dir), COUNTS), "stok_akhir")


# ---- movements -------------------------------------------------------------


def _movement_query(name: str, *branches: movements.Branch) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        policy = movements.HISTORY_POLICY.only(*branches)
        ledger = movements.movements(_source(spark, sf_dir), COUNTS, policy)
        return ledger.groupBy("kd_divisi", "kd_barang", "transaksi").agg(
            F.count(F.lit(1)).alias("baris"),
            F.sum("debet").cast("double").alias("debet"),
            F.sum("kredit").cast("double").alias("kredit"),
        )

    REGISTRY[name] = run


_movement_query("mv_opening", movements.OPENING)
_movement_query("mv_sales", movements.SALE)
_movement_query("mv_purchases", movements.PURCHASE)
_movement_query("mv_opname_in", movements.COUNT_IN)
_movement_query("mv_opname_out", movements.COUNT_OUT)
_movement_query("mv_transfer", movements.TRANSFER_OUT, movements.TRANSFER_IN)
_movement_query("mv_returns", movements.SALE_RETURN, movements.PURCHASE_RETURN)


@query
def ledger_all(spark, sf_dir):
    ledger = movements.movements(
        _source(spark, sf_dir), LedgerWindow(CLOSING), movements.HISTORY_POLICY
    )
    return ledger.groupBy("branch_no", "transaksi", "kd_divisi").agg(
        F.count(F.lit(1)).alias("baris"),
        F.sum("debet").cast("double").alias("debet"),
        F.sum("kredit").cast("double").alias("kredit"),
    )


# ---- snapshot --------------------------------------------------------------


@query
def snapshot_full(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query
def snapshot_orders_only(spark, sf_dir):
    return snapshot.stock_snapshot(_source(spark, sf_dir), ORDERS)


@query
def stock_as_of(spark, sf_dir):
    return snapshot.stock_as_of(_source(spark, sf_dir), ORDERS)


@query
def multi_server_snapshot(spark, sf_dir):
    return snapshot.stock_snapshot(_source(spark, sf_dir, by_region=True), COUNTS)


# ---- delta -----------------------------------------------------------------


@query
def delta_rows(spark, sf_dir):
    rows = delta.delta_rows(_source(spark, sf_dir), FEED)
    return _doubles(rows, "debet", "kredit")


@query
def delta_by_source(spark, sf_dir):
    return delta.delta_by_source(delta.delta_rows(_source(spark, sf_dir), FEED))


def _base_and_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = _source(spark, sf_dir)
    base = snapshot.stock_snapshot(source, BASE)
    return base, delta.accumulate(delta.delta_rows(source, FEED), source)


@query
def delta_accum(spark, sf_dir):
    source = _source(spark, sf_dir)
    return _doubles(delta.accumulate(delta.delta_rows(source, FEED), source), "delta_stok")


@query
def delta_applied(spark, sf_dir):
    return delta.apply_delta(*_base_and_delta(spark, sf_dir))


@query
def delta_unmatched(spark, sf_dir):
    return _doubles(delta.unmatched(*_base_and_delta(spark, sf_dir)), "delta_stok")


def _store(spark: SparkSession) -> SnapshotStore:
    return SnapshotStore(spark, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")


def _read_and_remove(store: SnapshotStore, df: DataFrame) -> DataFrame:
    """The rows as a table of their own, so that the store can go."""
    kept = reliable_checkpoint(df)
    store.remove()
    return kept


@query
def delta_refreshed_store(spark, sf_dir):
    """Full refresh, then a batch delta, through the snapshot store."""
    source, store = _source(spark, sf_dir), _store(spark)
    full_refresh(store, source, ORDERS, LAST_REFRESH)
    delta_refresh(store, source, ORDERS, END_OF_FEED)
    return _read_and_remove(store, store.read("main"))


KINDS = ["t_penjualan", "t_penjualan_retur", "t_pembelian", "t_pembelian_retur", "t_mutasi_stok"]


def _line_stream(spark, sf_dir) -> TestdataSource:
    """The tables with a stream of the line table, which may be one file or a folder of part files."""
    source = _source(spark, sf_dir)
    files, path = file_system(spark, f"{sf_dir}/lineitem.parquet")
    reader = spark.readStream.schema(source.lineitem.schema)
    if files.getFileStatus(path).isDirectory():
        lines = reader.parquet(f"{sf_dir}/lineitem.parquet")
    else:  # A stream reads folders; the pattern picks the one file out of its own.
        lines = reader.option("pathGlobFilter", path.getName()).parquet(sf_dir)
    return TestdataSource(spark, sf_dir, lineitem=lines)


def _stream(spark, sf_dir, store: SnapshotStore, checkpoint: str) -> None:
    """All lines not read before under ``checkpoint``."""
    source, feed = _source(spark, sf_dir), _line_stream(spark, sf_dir)
    run = stream_refresh(store, feed, source, FEED, f"{store.root}/{checkpoint}", ["main"], KINDS)
    run.awaitTermination()
    if checkpoint == "checkpoint" and not any(p["numInputRows"] for p in run.recentProgress):
        raise FileNotFoundError(f"the stream found no lines in {sf_dir}")


@query
def delta_stream(spark, sf_dir):
    """Full refresh, then a stream of the lines, through the snapshot store."""
    store = _store(spark)
    full_refresh(store, _source(spark, sf_dir), ORDERS, LAST_REFRESH)
    _stream(spark, sf_dir, store, "checkpoint")
    return _read_and_remove(store, store.read("main"))


def _land(spark, made: str, landing: str, name: str) -> None:
    """Move the files of a folder to where a stream looks for them, each at once and under a name of its own."""
    files, folder = file_system(spark, made)
    for file in files.listStatus(folder) if files.exists(folder) else ():
        path = file.getPath()
        _, target = file_system(spark, f"{landing}/{name}-{path.getName()}")
        if path.getName().startswith("part-") and not files.rename(path, target):
            raise OSError(f"{path} cannot land as {target}")


@query
def stream_late_headers(spark, sf_dir):
    """Lines and headers as streams: all lines first, half of the headers a batch later, the others after that."""
    source, store = _source(spark, sf_dir), _store(spark)
    full_refresh(store, source, ORDERS, LAST_REFRESH)
    lines, landing, frames = _line_stream(spark, sf_dir), f"{store.root}/headers", {}
    for kind in KINDS:
        # The headers are made once; a half of them lands as it is.
        heads = source.table(kind)
        number = next(c for c in heads.columns if c.startswith("no_"))
        dealt = heads.withColumn("half", F.pmod(F.xxhash64(number), F.lit(2)))
        dealt.write.partitionBy("half").parquet(f"{store.root}/made/{kind}")
        files, path = file_system(spark, f"{landing}/{kind}")
        files.mkdirs(path)
        frames[kind] = spark.readStream.schema(source.table(kind).schema).parquet(f"{landing}/{kind}")
        frames[f"{kind}_detail"] = lines.table(f"{kind}_detail")
    feed = FrameSource(spark, frames, None)
    # Each partition of a join's state has several files a batch; their number stays what it is in the first batch.
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(8, int(partitions))))
    try:
        for half in (None, 0, 1):
            for kind in KINDS if half is not None else ():
                _land(spark, f"{store.root}/made/{kind}/half={half}", f"{landing}/{kind}", str(half))
            stream_refresh(store, feed, source, FEED, f"{store.root}/checkpoint", ["main"], KINDS).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return _read_and_remove(store, store.read("main"))


@query
def store_stream_then_batch(spark, sf_dir):
    """A stream, then a delta up to the end of the feed: nothing counts twice."""
    store = _store(spark)
    full_refresh(store, _source(spark, sf_dir), ORDERS, LAST_REFRESH)
    _stream(spark, sf_dir, store, "checkpoint")
    delta_refresh(store, _source(spark, sf_dir), ORDERS, END_OF_FEED)
    return _read_and_remove(store, store.read("main"))


@query
def store_two_sites(spark, sf_dir):
    """Two of several sites, refreshed in full together and by deltas apart, one of them compacted."""
    source, store = _source(spark, sf_dir, by_region=True), _store(spark)
    full_refresh(store, source, ORDERS, LAST_REFRESH, ["0", "3"])
    for site in ("0", "3"):
        delta_refresh(store, source, ORDERS, END_OF_FEED, site)
    store.compact("3")
    return _read_and_remove(store, store.read())


@query
def delta_on_empty_store(spark, sf_dir):
    """Without a snapshot to start from, a delta becomes a full refresh."""
    source, store = _source(spark, sf_dir), _store(spark)
    delta_refresh(store, source, ORDERS, END_OF_FEED)
    return _read_and_remove(store, store.read("main"))


@query
def delta_empty(spark, sf_dir):
    """A delta without documents moves the refresh moment only."""
    source, store = _source(spark, sf_dir), _store(spark)
    full_refresh(store, source, ORDERS, END_OF_FEED)
    delta_refresh(store, source, ORDERS, AFTER_FEED)
    return _read_and_remove(store, _info(store))


def _info(store: SnapshotStore) -> DataFrame:
    return store.info().select(
        "server_key",
        "version",
        "kind",
        F.date_format("tanggal", "yyyy-MM-dd").alias("tanggal"),
        dates.as_text(F.col("last_refresh")).alias("last_refresh"),
        "row_count",
        "delta_rows",
        "updated_keys",
    )


@query
def snapshot_info(spark, sf_dir):
    """Stored state of each site after a full refresh and a delta."""
    source, store = _source(spark, sf_dir), _store(spark)
    full_refresh(store, source, ORDERS, LAST_REFRESH)
    delta_refresh(store, source, ORDERS, END_OF_FEED)
    return _read_and_remove(store, _info(store))


def _stored(spark, sf_dir) -> DataFrame:
    """The snapshot as the store holds it: reports over it read no documents."""
    store = _store(spark)
    store.publish(_snapshot(spark, sf_dir), COUNTS.as_of, END_OF_FEED, CLOSING, ["main"])
    return store.read("main")


@query
def report_stored(spark, sf_dir):
    return report.stock_report(_stored(spark, sf_dir))


@query
def low_stock_stored(spark, sf_dir):
    return report.low_stock(report.stock_report(_stored(spark, sf_dir)), 10)


@query
def kpi_stored(spark, sf_dir):
    return report.kpi_summary(report.stock_report(_stored(spark, sf_dir)))


@query
def search_stored(spark, sf_dir):
    return report.stock_report(report.search(_stored(spark, sf_dir), kode="10%"))


# ---- reports ---------------------------------------------------------------


@query
def report_all(spark, sf_dir):
    return report.stock_report(_snapshot(spark, sf_dir))


@query
def report_order(spark, sf_dir):
    """Every row of the snapshot with its place in the report."""
    return snapshot.with_position(_snapshot(spark, sf_dir))


@query
def kpi_summary(spark, sf_dir):
    return report.kpi_summary(report.stock_report(_snapshot(spark, sf_dir)))


@query
def low_stock(spark, sf_dir):
    return report.low_stock(report.stock_report(_snapshot(spark, sf_dir)), 10)


def _search_query(name: str, **wanted: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report.stock_report(report.search(_snapshot(spark, sf_dir), **wanted))

    REGISTRY[name] = run


_search_query("search_code_prefix", kode="10%")
_search_query("search_name_contains", nama="%D WID%")
_search_query("search_name_underscore", nama="%d_wid%")
_search_query("search_suffix", nama="%RING")
_search_query("search_exact", kode="106", nama="Red Widget")
_search_query("search_division", nama="red%", divisi="nation_7")


# ---- histories -------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return history.movement_history(_source(spark, sf_dir), CLOSING, **options)


@query
def history_item(spark, sf_dir):
    rows = _history(spark, sf_dir, items=HISTORY_ITEMS)
    return history.display(history.numbered(rows), ["no"])


@query
def history_division(spark, sf_dir):
    rows = _history(spark, sf_dir, divisions=["7", "24"])
    return history.display(history.numbered(rows), ["no"])


@query
def history_all(spark, sf_dir):
    return history.display(history.numbered(_history(spark, sf_dir)), ["no"])


@query
def history_view(spark, sf_dir):
    rows = _history(spark, sf_dir, known_only=True)
    return history.display(history.numbered(rows), ["no"])


@query
def history_base_units(spark, sf_dir):
    rows = _history(spark, sf_dir, opening_units="each")
    return history.display(history.numbered(rows), ["no"])


@query
def history_range(spark, sf_dir):
    rows = _history(spark, sf_dir, start="1998-03-01", end="1999-02-28")
    return history.display(history.with_balance(rows), ["no", "saldo"])


@query
def history_balance(spark, sf_dir):
    return history.display(history.with_balance(_history(spark, sf_dir)), ["no", "saldo"])


@query
def history_balance_converted(spark, sf_dir):
    rows = history.converted(_history(spark, sf_dir))
    return history.display(history.with_balance(rows), ["no", "saldo"])


@query
def history_balance_per_division(spark, sf_dir):
    rows = _history(spark, sf_dir)
    return history.display(history.with_balance(rows, reset_per_division=True), ["no", "saldo"])


@query
def history_balance_by_date(spark, sf_dir):
    return history.display(history.with_balance_by_date(_history(spark, sf_dir)), ["no", "saldo"])


@query
def history_balance_by_date_desc(spark, sf_dir):
    rows = history.with_balance_by_date(_history(spark, sf_dir), ascending=False)
    return history.display(rows, ["no", "saldo"])


@query
def history_unit_filter(spark, sf_dir):
    rows = history.with_unit(_history(spark, sf_dir), "Box")
    return history.display(history.with_balance(history.converted(rows)), ["no", "saldo"])


def _sorted_query(name: str, column: str, ascending: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = history.numbered(_history(spark, sf_dir))
        ordered = history.sorted_history(rows, column, ascending)
        return history.display(ordered, ["no", "urutan", "saldo"])

    REGISTRY[name] = run


_sorted_query("history_sorted_nulls_last", "kd_satuan", False)
_sorted_query("history_sorted_by_date_asc", "tanggal", True)
_sorted_query("history_sorted_by_date_desc", "tanggal", False)
_sorted_query("history_sorted_by_number", "debet", True)
_sorted_query("history_sorted_by_balance", "saldo", True)


@query
def history_totals(spark, sf_dir):
    return history.totals(history.converted(_history(spark, sf_dir)))


@query
def history_units(spark, sf_dir):
    return history.unit_names(_history(spark, sf_dir))


# ---- exports ---------------------------------------------------------------


def _exported(spark: SparkSession, expected: DataFrame, write: Callable[[str], None]) -> DataFrame:
    """What a written report reads back as; the files go once they have been read."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    write(path)
    # A null is written as nothing and a blank as two quotes; by default both would be read as nulls.
    reader = spark.read.schema(expected.schema).option("header", True).option("nullValue", "\u0000")
    found = reliable_checkpoint(reader.csv(path))
    files, there = file_system(spark, path)
    files.delete(there, True)
    return found


@query
def export_stock(spark, sf_dir):
    rows = report.stock_report(_snapshot(spark, sf_dir))
    return _exported(spark, reports.stock_export(rows), lambda path: reports.write_stock_report(rows, path))


def _export_history(spark: SparkSession, sf_dir: str, konversi: bool) -> DataFrame:
    rows = _history(spark, sf_dir, items=HISTORY_ITEMS)
    expected = reports.history_export(rows, konversi)
    return _exported(spark, expected, lambda path: reports.write_history_report(rows, path, konversi))


@query
def export_history(spark, sf_dir):
    return _export_history(spark, sf_dir, False)


@query
def export_history_converted(spark, sf_dir):
    return _export_history(spark, sf_dir, True)


# ---- several result sets, tables that are absent ---------------------------


@query
def costing_both(spark, sf_dir):
    """Both inputs of a cost calculation, told apart by ``hasil``."""
    parts = costing.costing_inputs(_source(spark, sf_dir), COUNTS)
    none = F.lit(None).cast("string")
    stock = _doubles(parts["stok_akhir"], "stok_akhir").select(
        F.lit("stok_akhir").alias("hasil"),
        "kd_barang",
        none.alias("tanggal"),
        none.alias("jenis"),
        F.col("stok_akhir").alias("stok"),
        F.lit(None).cast("double").alias("harga"),
    )
    layers = parts["histori_masuk"].select(
        F.lit("histori_masuk").alias("hasil"),
        "kd_barang",
        dates.as_text(F.col("tanggal")).alias("tanggal"),
        "jenis",
        "stok",
        "harga",
    )
    return stock.unionByName(layers)


@query
def ledger_without_returns(spark, sf_dir):
    """Sites without tables of returns: they count as empty, the rest of the ledger stays."""
    source = _source(spark, sf_dir)
    names = [name for name in schemas.TABLES if "retur" not in name and source.exists(name)]
    partial = FrameSource(spark, {name: source.table(name) for name in names}, "main", on_missing="empty")
    ledger = movements.movements(partial, LedgerWindow(CLOSING), movements.HISTORY_POLICY)
    return ledger.groupBy("branch_no", "transaksi", "kd_divisi").agg(
        F.count(F.lit(1)).alias("baris"),
        F.sum("debet").cast("double").alias("debet"),
        F.sum("kredit").cast("double").alias("kredit"),
    )


@query
def ledger_corrupt_returns(spark, sf_dir):
    """A part file of the returned lines is no parquet: that branch counts as empty, and the file is named."""
    source, root = _source(spark, sf_dir), f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"
    returns = [name for name in schemas.TABLES if "retur" in name]
    for name in returns:
        source.table(name).write.parquet(f"{root}/{name}")
    files, path = file_system(spark, f"{root}/t_penjualan_retur_detail/part-broken.parquet")
    out = files.create(path, False)
    out.write(bytearray(b"no parquet"))
    out.close()
    lake = ParquetSource(spark, root, on_missing="empty")
    frames = {name: lake.table(name) if name in returns else source.table(name) for name in schemas.TABLES}
    ledger = movements.movements(FrameSource(spark, frames, None), LedgerWindow(CLOSING), movements.HISTORY_POLICY)
    left_out = F.regexp_extract(F.lit(str(lake.missing)), "[^/]*[.]parquet", 0)
    found = ledger.groupBy("branch_no", "transaksi", "kd_divisi").agg(
        F.count(F.lit(1)).alias("baris"),
        F.sum("debet").cast("double").alias("debet"),
        F.sum("kredit").cast("double").alias("kredit"),
        F.concat_ws(",", F.lit(",".join(sorted(lake.missing))), F.max(left_out)).alias("dilewati"),
    )
    kept = reliable_checkpoint(found)
    files, there = file_system(spark, root)
    files.delete(there, True)
    return kept
