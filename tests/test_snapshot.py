import pytest
from pyspark.sql import functions as F

from stockledger.operators.items import item_master
from stockledger.operators.movements import COUNT_OUT, HISTORY_POLICY, SNAPSHOT_POLICY, movements
from stockledger.operators.purchases import last_buy_price, weighted_average_price
from stockledger.params import LedgerWindow
from stockledger.plans.snapshot import in_report_order, stock_as_of, stock_snapshot
from tests.conftest import CLOSING, dimensions, item, purchase, rows, sale, split, unit

WINDOW = LedgerWindow(CLOSING, "2024-03-31")


def test_unit_factor_zero_null_and_missing(tables):
    """Snapshot: all count as 1. One statement: zero stays zero."""
    source = tables(
        **dimensions(),
        m_barang=[item("1")],
        m_barang_satuan=[
            unit("1", "PCS", 1), unit("1", "BOX", 12), unit("1", "NOL", 0), unit("1", "NUL", None),
        ],
        **split("t_penjualan", [
            sale("S1", "A", "1", 1, "BOX"),
            sale("S2", "A", "1", 2, "NOL"),
            sale("S3", "A", "1", 3, "NUL"),
            sale("S4", "A", "1", 4, "KRT"),
            sale("S5", "A", "1", 5, None),
        ]),
    )
    assert rows(stock_snapshot(source, WINDOW), "kd_barang", "stok_akhir") == [("1", -26.0)]
    assert rows(stock_as_of(source, WINDOW), "`Kode Barang`", "`Stok Akhir`") == [("1", -24.0)]


def test_two_base_units_keep_the_first_code(tables):
    source = tables(
        **dimensions(),
        m_barang=[item("1"), item("2")],
        m_barang_satuan=[
            unit("1", "PCS", 1, 10), unit("1", "BJI", 1, 11),
            unit("2", "PCS", 1, 10), unit("2", "BJI", 1, 11, status=0),
        ],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": k, "stok_awal": 5} for k in "12"],
    )
    assert rows(item_master(source), "kd_barang", "kd_satuan_terkecil", "harga_jual") == [
        ("1", "BJI", 11), ("2", "PCS", 10),
    ]
    assert rows(stock_snapshot(source, WINDOW), "kd_barang", "stok_akhir", "harga_jual") == [
        ("1", 5.0, 11.0), ("2", 5.0, 10.0),
    ]


def test_master_drops_inactive_and_incomplete_items(tables):
    source = tables(
        **dimensions(),
        m_barang=[
            item("ok"), item("off", kd_kategori="X"), item("brandless", kd_merk="?"),
            item("nounit"), item("unsold"), item("nullstatus"),
        ],
        m_barang_satuan=[
            unit("ok", "PCS", 1), unit("off", "PCS", 1), unit("brandless", "PCS", 1),
            unit("nounit", "BOX", 12), unit("unsold", "PCS", 1, status=0),
            unit("nullstatus", "PCS", 1, status=None),
        ],
        m_barang_divisi=[
            {"kd_divisi": "A", "kd_barang": k, "stok_awal": 1}
            for k in ("ok", "off", "brandless", "nounit", "unsold", "nullstatus", "ghost")
        ],
    )
    assert rows(item_master(source), "kd_barang") == [("ok",)]
    assert rows(stock_snapshot(source, WINDOW), "kd_barang") == [("ok",)]


@pytest.mark.parametrize(
    ("tanggal", "counts"),
    [
        ("2024-01-31 11:59:59", False),
        ("2024-01-31 12:00:00", False),
        ("2024-01-31 12:00:01", True),
        ("2024-02-01 00:00:00", True),
        ("2024-03-31 23:59:59", True),
        ("2024-04-01 00:00:00", False),
        (None, False),
    ],
)
def test_ledger_window_edges(tables, tanggal, counts):
    source = tables(**split("t_penjualan", [sale("S", "A", "1", 1, tanggal=tanggal)]))
    ledger = movements(source, LedgerWindow(CLOSING, "2024-03-31 07:00:00"), SNAPSHOT_POLICY)
    assert ledger.count() == (1 if counts else 0)


def test_unknown_division_keeps_its_code_in_the_snapshot_only(tables):
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1)],
        **split("t_penjualan", [sale("S1", "A", "1", 1), sale("S2", "Z", "1", 2)]),
    )
    assert rows(stock_snapshot(source, WINDOW), "kd_divisi", "divisi") == [("A", "Div A"), ("Z", "Z")]
    assert rows(stock_as_of(source, WINDOW), "`Kode Divisi`") == [("A",)]


def test_price_fallback_differs(tables):
    """Never bought: 0 in the snapshot, highest opening cost in the one statement."""
    opening = [
        {"kd_divisi": d, "kd_barang": "1", "stok_awal": 1, "harga_beli_awal": h}
        for d, h in (("A", 7), ("B", 9))
    ]
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=opening,
    )
    assert rows(stock_snapshot(source, WINDOW), "harga_beli_akhir", "harga_avg") == [(0.0, 0.0)] * 2
    assert rows(stock_as_of(source, WINDOW), "`Harga Beli Akhir`") == [(9.0,)] * 2


def test_last_price_takes_latest_date_then_document(tables):
    source = tables(
        **split("t_pembelian", [
            purchase("P1", "A", "1", 1, tanggal="2024-02-05 00:00:00", harga=5),
            purchase("P3", "A", "1", 1, tanggal="2024-02-07 00:00:00", harga=7),
            purchase("P2", "A", "1", 1, tanggal="2024-02-07 00:00:00", harga=6),
            purchase("P4", "A", "1", 1, tanggal=None, harga=99),
            purchase("P5", "A", "2", 1, harga=None),
        ]),
    )
    assert rows(last_buy_price(source), "kd_barang", "harga_beli") == [("1", 7), ("2", None)]


def test_average_price_is_zero_without_positive_quantity(tables):
    source = tables(
        **split("t_pembelian", [
            purchase("P1", "A", "1", 1, harga=10), purchase("P2", "A", "1", 3, harga=20),
            purchase("P3", "A", "2", 2, harga=10), purchase("P4", "A", "2", -2, harga=30),
        ]),
    )
    found = {k: float(v) for k, v in rows(weighted_average_price(source), "kd_barang", "harga_avg")}
    assert found == {"1": 17.5, "2": 0.0}


def test_counts_and_purchase_status_by_product(tables):
    counts = [
        {"no_transaksi": f"O{s}", "kd_divisi": "A", "kd_barang": "1", "qty": q, "kd_satuan": "PCS",
         "tanggal": "2024-02-02 00:00:00", "status": s}
        for s, q in ((2, 10), (1, 3), (None, 100))
    ]
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1)],
        t_opname_stok=counts,
        **split("t_pembelian", [
            purchase("P0", "A", "1", 1, status=0), purchase("P2", "A", "1", 50, status=2),
            purchase("PN", "A", "1", 500, status=None),
        ]),
    )
    assert rows(stock_snapshot(source, WINDOW), "stok_akhir") == [(561.0,)]
    assert rows(stock_as_of(source, WINDOW), "`Stok Akhir`") == [(8.0,)]
    out = movements(source, WINDOW, HISTORY_POLICY.only(COUNT_OUT))
    assert rows(out, "no_transaksi", "debet", "kredit") == [("O1", 0, 3)]


def test_transfer_is_one_row_out_and_one_in(tables):
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1), unit("1", "BOX", 6)],
        t_mutasi_stok=[{"no_transaksi": "M", "kd_divisi_asal": "A", "kd_divisi_tujuan": "B",
                        "tanggal": "2024-02-02 00:00:00"}],
        t_mutasi_stok_detail=[{"no_transaksi": "M", "kd_barang": "1", "qty": 2, "kd_satuan": "BOX"}],
    )
    assert rows(stock_snapshot(source, WINDOW), "kd_divisi", "stok_akhir") == [("A", -12.0), ("B", 12.0)]


def test_null_quantities_count_as_zero_in_the_snapshot(tables):
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": None}],
    )
    assert rows(stock_snapshot(source, WINDOW), "stok_akhir") == [(0.0,)]
    assert rows(stock_as_of(source, WINDOW), "`Stok Akhir`") == [(None,)]


def test_report_order(tables):
    source = tables(
        **dimensions(), m_barang=[item("1", nama="b"), item("2", nama="a")],
        m_barang_satuan=[unit("1", "PCS", 1), unit("2", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": d, "kd_barang": k, "stok_awal": 1} for d in "BA" for k in "12"],
    )
    ordered = in_report_order(stock_snapshot(source, WINDOW)).select("divisi", "barang").collect()
    assert [tuple(r) for r in ordered] == [
        ("Div A", "a"), ("Div A", "b"), ("Div B", "a"), ("Div B", "b"),
    ]


def test_stock_sums_are_exact(tables):
    source = tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1), unit("1", "GR", "0.0001")],
        **split("t_penjualan", [
            sale(f"S{i}", "A", "1", "0.1", "PCS" if i % 2 else "GR") for i in range(10)
        ]),
    )
    assert rows(stock_snapshot(source, WINDOW), "stok_akhir") == [(-0.5001,)]
    assert stock_snapshot(source, WINDOW).where(F.col("stok_akhir").isNull()).isEmpty()
