"""Where lines and headers wait for each other."""

from stockledger.params import LedgerWindow
from stockledger.sinks.snapshot_store import SnapshotStore
from stockledger.sources import FrameSource
from stockledger.streaming.documents import STATE_CONF
from stockledger.streaming.refresh import full_refresh, stream_refresh
from tests.conftest import CLOSING, dimensions, item, sale, split, unit

T0 = "2024-02-15 00:00:00"
WINDOW = LedgerWindow(CLOSING, "2024-03-31")


def test_waiting_lines_lie_on_disk_and_carry_what_is_added_up_only(spark, tables, tmp_path):
    source = tables(
        **dimensions(),
        m_barang=[item("1")],
        m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 1000}],
        **split("t_penjualan", [sale("s1", "A", "1", 1, server="2024-02-20 00:00:00")]),
    )
    frames = {name: source.table(name) for name in source.frames}
    for name in ("t_penjualan", "t_penjualan_detail"):
        source.table(name).coalesce(1).write.parquet(str(tmp_path / name))
        frames[name] = spark.readStream.schema(source.table(name).schema).parquet(str(tmp_path / name))
    feed, store = FrameSource(spark, frames, "main", on_missing="empty"), SnapshotStore(spark, str(tmp_path / "store"))
    full_refresh(store, source, WINDOW, T0)
    run = stream_refresh(store, feed, source, WINDOW.changed_since(T0), str(tmp_path / "c"), ["main"], ["t_penjualan"])
    run.awaitTermination()
    assert store.read("main").first().stok_akhir == 999
    states = run.lastProgress["stateOperators"]
    assert states and all(any(name.startswith("rocksdb") for name in state["customMetrics"]) for state in states)
    plan = run._jsq.explainInternal(True)
    (join,) = [part for part in plan.split("== Physical Plan ==")[-1].split("StreamingSymmetricHashJoin")[1:]]
    assert "harga_jual" not in join.split("FileScan")[0] and "line_no" not in join.split("FileScan")[0]
    assert all(spark.conf.get(key, None) is None for key in STATE_CONF)
