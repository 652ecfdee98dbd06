"""Lines and headers of documents as two streams, in any order."""

import pytest

from stockledger.params import LedgerWindow
from stockledger.sinks.snapshot_store import SnapshotStore
from stockledger.sources import FrameSource
from stockledger.streaming.refresh import full_refresh, stream_refresh
from tests.conftest import CLOSING, dimensions, item, sale, split, unit

T0 = "2024-02-15 00:00:00"
WINDOW = LedgerWindow(CLOSING, "2024-03-31")


@pytest.mark.parametrize("wait", [None, "2 days"])
def test_a_line_two_batches_before_its_header_counts_once(spark, tables, tmp_path, wait):
    documents = [sale(no, "A", "1", qty, server="2024-02-20 00:00:00") for no, qty in (("s1", 1), ("s2", 10), ("s3", 100))]
    source = tables(
        **dimensions(),
        m_barang=[item("1")],
        m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 1000}],
        **split("t_penjualan", documents),
    )
    frames = {name: source.table(name) for name in source.frames}
    for name in ("t_penjualan", "t_penjualan_detail"):
        (tmp_path / name).mkdir()
        frames[name] = spark.readStream.schema(source.table(name).schema).parquet(str(tmp_path / name))
    feed = FrameSource(spark, frames, "main", on_missing="empty")
    feed.wait = wait
    store = SnapshotStore(spark, str(tmp_path / "store"))
    # Base without the documents: they reach the server after T0.
    full_refresh(store, source, WINDOW, T0)

    def batch(lines=(), heads=()):
        for name, numbers in (("t_penjualan_detail", lines), ("t_penjualan", heads)):
            if numbers:
                arrived = source.table(name).where(source.table(name).no_transaksi.isin(*numbers))
                arrived.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        changed = WINDOW.changed_since(T0)
        stream_refresh(store, feed, source, changed, str(tmp_path / "c"), ["main"], ["t_penjualan"]).awaitTermination()
        return store.read("main").first().stok_akhir

    assert batch(lines=["s1"]) == 1000
    assert batch(lines=["s2"], heads=["s3"]) == 1000  # s3 is a header before its line
    assert batch(heads=["s1"]) == 999
    assert batch(heads=["s1", "s2"]) == 989  # a header sent again changes nothing
    assert batch(lines=["s3"]) == 889
    assert batch() == 889
