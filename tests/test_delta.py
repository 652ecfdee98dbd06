"""Deltas in batch, through the store, and from a stream."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockledger.params import LedgerWindow
from stockledger.plans import delta as D
from stockledger.plans.snapshot import stock_snapshot
from stockledger.sinks import snapshot_store
from stockledger.sinks.snapshot_store import SnapshotStore
from stockledger.sources import FrameSource
from stockledger.streaming.refresh import delta_refresh, full_refresh, stream_refresh
from tests.conftest import CLOSING, dimensions, item, purchase, rows, sale, split, unit

WINDOW = LedgerWindow(CLOSING, "2024-03-31")
FIRST, SECOND, THIRD = "2024-02-15 00:00:00", "2024-03-01 00:00:00", "2024-04-01 00:00:00"


@pytest.fixture(scope="module")
def source(tables):
    return tables(
        **dimensions(),
        m_barang=[item("1"), item("2"), item("off", kd_kategori="X")],
        m_barang_satuan=[unit("1", "PCS", 1), unit("1", "BOX", 12), unit("1", "NOL", 0),
                         unit("2", "PCS", 1), unit("off", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 100}],
        t_opname_stok=[{"no_transaksi": "O", "kd_divisi": "A", "kd_barang": "1", "qty": 9,
                        "kd_satuan": "PCS", "tanggal": "2024-03-05 00:00:00", "status": 2}],
        t_mutasi_stok=[{"no_transaksi": "M", "kd_divisi_asal": "A", "kd_divisi_tujuan": "B",
                        "tanggal": "2024-02-20 00:00:00", "tanggal_server": "2024-02-20 01:00:00"}],
        t_mutasi_stok_detail=[{"no_transaksi": "M", "kd_barang": "1", "qty": 1, "kd_satuan": "BOX"}],
        **split("t_penjualan", [
            sale("old", "A", "1", 1, server=FIRST),
            sale("late", "A", "1", 2, "BOX", tanggal="2024-02-01 00:00:00", server="2024-03-20 00:00:00"),
            sale("zero", "A", "1", 3, "NOL", server="2024-02-15 00:00:01"),
            sale("before", "A", "1", 50, tanggal=CLOSING, server="2024-03-20 00:00:00"),
            sale("after", "A", "1", 60, tanggal="2024-04-01 00:00:00", server="2024-03-20 00:00:00"),
            sale("new", "B", "2", 4, server="2024-03-20 00:00:00"),
            sale("undated", "A", "1", 5, server=None),
            sale("off", "A", "off", 6, server="2024-03-20 00:00:00"),
        ]),
        **split("t_pembelian", [
            purchase("P", "A", "1", "0.3", status=2, tanggal="2024-02-25 00:00:00",
                     server="2024-02-25 00:00:00", harga=77),
        ]),
    )


def stock(df):
    return rows(df, "kd_divisi", "kd_barang", "stok_akhir")


def test_rows_of_the_feed(source):
    found = D.delta_rows(source, WINDOW.changed_since(FIRST)).withColumn("net", F.expr("double(debet - kredit)"))
    assert rows(found, "source", "kd_divisi", "net") == [
        ("mutasi_in", "B", 1.0), ("mutasi_out", "A", -1.0), ("pembelian", "A", 0.3),
        ("penjualan", "A", -2.0), ("penjualan", "A", -3.0), ("penjualan", "A", -6.0),
        ("penjualan", "B", -4.0),
    ]
    with pytest.raises(ValueError):
        D.delta_rows(source, WINDOW)


def test_net_change_per_key(source):
    found = D.accumulate(D.delta_rows(source, WINDOW.changed_since(FIRST)), source)
    assert {(r.kd_divisi, r.kd_barang): float(r.delta_stok) for r in found.collect()} == {
        ("A", "1"): -12 - 24 - 3 + 0.3, ("B", "1"): 12, ("B", "2"): -4, ("A", "off"): -6,
    }


def test_base_plus_delta_is_the_full_snapshot_without_counts(source):
    base = stock_snapshot(source, WINDOW.known_at(FIRST))
    change = D.accumulate(D.delta_rows(source, WINDOW.changed_since(FIRST)), source)
    full = {k[:2]: k[2] for k in stock(stock_snapshot(source, WINDOW))}
    updated = stock(D.apply_delta(base, change))
    assert updated == [("A", "1", full["A", "1"])]
    assert rows(D.unmatched(base, change), "kd_divisi", "kd_barang") == [("A", "off"), ("B", "1"), ("B", "2")]
    kept = [c for c in base.columns if c != "stok_akhir"]
    assert rows(D.apply_delta(base, change), *kept) == rows(base, *kept)


def test_store_round_trip(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.needs_full_refresh("main") and store.meta().isEmpty()
    with pytest.raises(LookupError):
        store.read()
    assert delta_refresh(store, source, WINDOW, FIRST) == "full"
    before = stock(store.read("main"))
    assert delta_refresh(store, source, WINDOW, SECOND) == "delta"
    assert delta_refresh(store, source, WINDOW, "2024-03-10 00:00:00") == "unchanged"
    assert store.last_refresh("main") == datetime(2024, 3, 10)
    assert delta_refresh(store, source, WINDOW, THIRD) == "delta"
    full = {k[:2]: k[2] for k in stock(stock_snapshot(source, WINDOW))}
    assert stock(store.read("main")) == [("A", "1", full["A", "1"])] != before
    info = store.info().collect()
    assert [(r.version, r.step, r.kind, r.row_count, r.delta_rows, r.updated_keys) for r in info] == [
        (1, 3, "delta", 1, 3, 1)
    ]
    assert info[0].tanggal == date(2024, 3, 31)
    assert store.compact("main") == 2
    assert stock(store.read()) == [("A", "1", full["A", "1"])]
    assert store.last_refresh("main") == datetime(2024, 4, 1)


def test_another_day_needs_a_full_refresh(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, LedgerWindow(CLOSING, "2024-02-10"), THIRD)
    assert delta_refresh(store, source, WINDOW, THIRD) == "full"
    assert stock(store.read("main")) == stock(stock_snapshot(source, WINDOW))


def test_a_batch_is_applied_once(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, WINDOW, FIRST)
    change = D.accumulate(D.delta_rows(source, WINDOW.changed_since(FIRST)), source)
    assert store.append_delta(["main"], change, "b1", SECOND, 7) == ["main"]
    once = stock(store.read())
    assert store.append_delta(["main"], change, "b1", SECOND, 7) == []
    assert stock(store.read()) == once
    assert store.append_delta(["main"], change, "b2", SECOND, 7) == ["main"]
    assert stock(store.read()) != once
    with pytest.raises(ValueError):
        store.append_delta(["main"], change, "s1", None, 7, feed="stream-x")
    with pytest.raises(LookupError):
        store.append_delta(["main", "nowhere"], change, "b3", SECOND, 7)


def test_many_changes_are_folded_together(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot_store, "COMPACT_AFTER", 2)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, WINDOW, FIRST)
    delta_refresh(store, source, WINDOW, SECOND)
    before = store.state("main")
    delta_refresh(store, source, WINDOW, THIRD)
    after, full = store.state("main"), {k[:2]: k[2] for k in stock(stock_snapshot(source, WINDOW))}
    assert (before["version"], after["version"], after["step"], after["kind"]) == (1, 2, 0, "compact")
    assert after["last_refresh"] == datetime(2024, 4, 1) and after["closing_ts"] == datetime(2024, 1, 31, 12)
    assert stock(store.read("main")) == [("A", "1", full["A", "1"])]


def test_sites_are_refreshed_apart(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    snapshot = stock_snapshot(source, WINDOW.known_at(FIRST))
    north, south = (snapshot.withColumn("server_key", F.lit(k)) for k in ("n", "s"))
    store.publish(north.unionByName(south), "2024-03-31", FIRST, CLOSING)
    change = D.accumulate(D.delta_rows(source, WINDOW.changed_since(FIRST)), source)
    store.append_delta(["n", "s"], change.withColumn("server_key", F.lit("n")), "b", SECOND)
    store.publish(south.withColumn("stok_akhir", F.lit(1.0)), "2024-03-31", THIRD, CLOSING)
    assert rows(store.read("s"), "stok_akhir") == [(1.0,)]
    changed = rows(store.read("n"), "stok_akhir")
    assert changed != rows(north, "stok_akhir") and store.read().count() == 2
    assert rows(store.info(), "server_key", "version") == [("n", 1), ("s", 2)]
    assert store.compact("n") == 2 and rows(store.read("n"), "stok_akhir") == changed
    assert store.last_refresh("n") == datetime(2024, 3, 1) and store.last_refresh("s") == datetime(2024, 4, 1)


def test_a_site_without_rows_is_replaced_too(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    snapshot = stock_snapshot(source, WINDOW)
    store.publish(snapshot, "2024-03-31", FIRST, CLOSING, ["main", "empty"])
    assert rows(store.info(), "server_key", "row_count") == [("empty", 0), ("main", 3)]
    store.publish(snapshot.limit(0), "2024-03-31", SECOND, CLOSING, ["main"])
    assert store.read().count() == store.read("main").count() == 0
    assert not store.needs_full_refresh("empty")


def test_a_new_closing_needs_a_full_refresh(spark, source, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, WINDOW, FIRST)
    later = LedgerWindow("2024-02-22 00:00:00", "2024-03-31")
    assert delta_refresh(store, source, later, THIRD) == "full"
    assert stock(store.read("main")) == stock(stock_snapshot(source, later))


class Shop:
    """One item of which 100 are there at T0 and sales of 10 follow; the same at every site."""

    T0, T1, T2 = "2024-02-15 00:00:00", "2024-02-20 00:00:00", "2024-03-01 00:00:00"

    def __init__(self, tables, spark, folder, server_key="main"):
        self.source = tables(
            server_key,
            **dimensions(),
            m_barang=[item("1")],
            m_barang_satuan=[unit("1", "PCS", 1)],
            m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 100}],
            **split("t_penjualan", [sale("s", "A", "1", 10, tanggal="2024-02-10 00:00:00", server=self.T1)]),
        )
        lines = self.source.table("t_penjualan_detail")
        lines.write.parquet(folder)
        frames = {name: self.source.table(name) for name in self.source.frames}
        frames["t_penjualan_detail"] = spark.readStream.schema(lines.schema).parquet(folder)
        self.feed = FrameSource(spark, frames, server_key, on_missing="empty")
        self.server_key = server_key

    def stream(self, store, checkpoint):
        run = stream_refresh(
            store, self.feed, self.source, WINDOW.changed_since(self.T0), str(checkpoint), [self.server_key], ["t_penjualan"]
        )
        run.awaitTermination()

    def left(self, store):
        return [r.stok_akhir for r in store.read(self.server_key).collect()]


@pytest.fixture
def shop(tables, spark, tmp_path):
    return Shop(tables, spark, str(tmp_path / "lines"))


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_a_delta_after_a_stream_counts_nothing_twice(shop, store, tmp_path):
    full_refresh(store, shop.source, WINDOW, shop.T0)
    shop.stream(store, tmp_path / "c")
    assert shop.left(store) == [90.0]
    assert store.state("main")["covered_until"] == datetime(2024, 2, 20)
    assert delta_refresh(store, shop.source, WINDOW, shop.T2) == "full"
    assert shop.left(store) == [90.0]
    # A stream with a new checkpoint reads everything again: what the base holds is passed over.
    shop.stream(store, tmp_path / "d")
    assert shop.left(store) == [90.0]


def test_a_full_refresh_between_two_streams_loses_and_doubles_nothing(shop, store, tmp_path):
    full_refresh(store, shop.source, WINDOW, shop.T0)
    shop.stream(store, tmp_path / "c")
    with pytest.raises(ValueError):  # The stream has read past T0, so this would lose the sale.
        full_refresh(store, shop.source, WINDOW, shop.T0)
    full_refresh(store, shop.source, WINDOW, shop.T2)
    shop.stream(store, tmp_path / "c")
    assert shop.left(store) == [90.0]


def test_each_site_has_batches_of_its_own(tables, spark, store, tmp_path):
    for site in ("a", "b"):
        shop = Shop(tables, spark, str(tmp_path / f"lines-{site}"), site)
        full_refresh(store, shop.source, WINDOW, shop.T0)
        shop.stream(store, tmp_path / f"c-{site}")
        assert shop.left(store) == [90.0]


def test_a_rebuilt_version_takes_the_same_delta_again(shop, store):
    for _ in range(2):
        full_refresh(store, shop.source, WINDOW, shop.T0)
        assert shop.left(store) == [100.0]
        assert delta_refresh(store, shop.source, WINDOW, shop.T2) == "delta"
        assert shop.left(store) == [90.0] and store.last_refresh("main") == datetime(2024, 3, 1)
    assert delta_refresh(store, shop.source, WINDOW, shop.T2) == "unchanged"


def test_an_attempt_that_dies_before_its_meta_row_leaves_nothing(tables, spark, store, tmp_path, monkeypatch):
    a, b = (Shop(tables, spark, str(tmp_path / f"lines-{k}"), k) for k in "ab")

    def die(rows):
        raise OSError("no more disk")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_publish", die)
        with pytest.raises(OSError):
            full_refresh(store, a.source, WINDOW, a.T0)
    full_refresh(store, b.source, WINDOW, b.T2)
    assert rows(store.info(), "server_key") == [("b",)] and store.last_refresh("a") is None
    assert store.read().select("server_key").distinct().count() == 1


def test_streams_name_their_kinds_and_sites(shop, store, tmp_path):
    changes = WINDOW.changed_since(shop.T0)
    for sites, kinds, error in ((["main"], [], ValueError), (["main"], ["t_pembelian"], ValueError), (["x"], ["t_penjualan"], LookupError)):
        with pytest.raises(error):
            stream_refresh(store, shop.feed, shop.source, changes, str(tmp_path / "c"), sites, kinds)
    store.publish(stock_snapshot(shop.source, WINDOW).limit(0), "2024-03-31", shop.T0, CLOSING, ["other"])
    run = stream_refresh(store, shop.feed, shop.source, changes, str(tmp_path / "c"), ["other"], ["t_penjualan"])
    with pytest.raises(Exception, match="other sites"):
        run.awaitTermination()


@pytest.mark.parametrize("files", [1, 3, 5])
def test_stream_equals_batch_for_any_split(spark, source, tmp_path, files):
    frames = {name: source.table(name) for name in source.frames}
    feed_frames = dict(frames)
    for name in ("t_penjualan_detail", "t_pembelian_detail", "t_mutasi_stok_detail"):
        path = str(tmp_path / name)
        parts = frames[name].withColumn("part", F.pmod(F.xxhash64("no_transaksi"), F.lit(files)))
        for i in range(files):
            parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
        feed_frames[name] = (
            spark.readStream.schema(frames[name].schema).option("maxFilesPerTrigger", 1).parquet(path)
        )
    feed = FrameSource(spark, feed_frames, "main", on_missing="empty")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, WINDOW, FIRST)
    changes = WINDOW.changed_since(FIRST)
    for _ in range(2):  # The second run finds nothing new.
        stream_refresh(
            store, feed, source, changes, str(tmp_path / "checkpoint"), ["main"],
            ["t_penjualan", "t_pembelian", "t_mutasi_stok"],
        ).awaitTermination()
    base = stock_snapshot(source, WINDOW.known_at(FIRST))
    change = D.accumulate(D.delta_rows(source, changes), source)
    assert stock(store.read("main")) == stock(D.apply_delta(base, change))


def test_counts_by_source(source):
    found = D.delta_by_source(D.delta_rows(source, WINDOW.changed_since(FIRST)))
    assert rows(found, "source", "row_count") == [
        ("mutasi_in", 1), ("mutasi_out", 1), ("pembelian", 1), ("penjualan", 4),
    ]
