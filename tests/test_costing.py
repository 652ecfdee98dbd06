import pytest

from stockledger.params import LedgerWindow
from stockledger.plans.costing import costing_inputs, inbound_layers, purchase_layers, stock_per_item
from tests.conftest import CLOSING, dimensions, item, purchase, rows, sale, split, unit

WINDOW = LedgerWindow(CLOSING, "2024-03-31")

DISCOUNTS = {
    "percent": (dict(harga=100, diskon1="0.1", diskon2="0.2"), 100 * 0.9 * 0.8),
    "amount": (dict(harga=100, diskon1=5, diskon3=7), 88.0),
    "mixed_amount_last": (dict(harga=100, diskon1=10, diskon2="0.5"), 40.0),
    "negative_percent": (dict(harga=100, diskon1="-0.1"), 110.0),
    "negative_amount": (dict(harga=100, diskon4=-5), 105.0),
    "one_is_an_amount": (dict(harga=100, diskon1=1), 99.0),
    "header_percent": (dict(harga=100, h_diskon1="0.1"), 90.0),
    "header_amount_ignored": (dict(harga=100, h_diskon2=10), 100.0),
    "taxes": (dict(harga=100, h_pajak="0.1", h_ppnbm="0.2"), 100 * 1.1 * 1.2),
    "per_smallest_unit": (dict(harga=120, satuan="BOX"), 10.0),
    "zero_factor": (dict(harga=120, satuan="NOL"), 0.0),
    "zero_factor_null_price": (dict(harga=None, satuan="NOL"), 0.0),
    "null_factor": (dict(harga=120, satuan="NUL"), 120.0),
    "negative_price": (dict(harga=-3, diskon1=5), 0.0),
    "null_price": (dict(harga=None), None),
}


def test_net_buy_price(tables):
    source = tables(
        m_barang_satuan=[
            unit("1", "PCS", 1), unit("1", "BOX", 12), unit("1", "NOL", 0), unit("1", "NUL", None),
        ],
        **split("t_pembelian", [purchase(n, "A", "1", 2, **d) for n, (d, _) in DISCOUNTS.items()]),
    )
    found = {r.no_transaksi: r.harga for r in purchase_layers(source).collect()}
    for name, (_, expected) in DISCOUNTS.items():
        if expected is None:
            assert found[name] is None
        else:
            assert found[name] == pytest.approx(expected), name


def test_layers_include_the_closing_day(tables):
    dates = ("2024-01-30 23:59:59", "2024-01-31 00:00:00", "2024-03-31 23:59:59", "2024-04-01 00:00:00")
    source = tables(
        m_barang_satuan=[unit("1", "PCS", 1), unit("1", "BOX", 12)],
        t_opname_stok=[
            {"no_transaksi": t, "kd_divisi": "A", "kd_barang": "1", "qty": 2, "kd_satuan": "BOX",
             "tanggal": t, "status": s}
            for t in dates for s in (2, 1)
        ],
        **split("t_pembelian", [purchase(t, "A", "1", 3, tanggal=t) for t in dates]),
    )
    layers = inbound_layers(source, WINDOW)
    assert rows(layers, "jenis", "stok", "harga") == [("OPNAME", 24.0, 0.0)] * 2 + [
        ("PEMBELIAN", 3.0, 8.0)
    ] * 2


def test_opening_layer_averages_only_stocked_divisions(tables):
    def opening(kode, divisi, stok, harga):
        return {"kd_divisi": divisi, "kd_barang": kode, "stok_awal": stok, "harga_beli_awal": harga}

    source = tables(
        m_barang_divisi=[
            opening("1", "A", 2, 10), opening("1", "B", 4, 20), opening("1", "C", 0, 900),
            opening("1", "D", None, 900), opening("1", "E", 1, None), opening("2", "A", 0, 5),
        ],
    )
    assert rows(inbound_layers(source, WINDOW), "kd_barang", "stok", "harga") == [
        ("1", 7.0, 15.0), ("2", 0.0, 0.0),
    ]


def test_stock_per_item_gates_opening_and_sales_by_category(tables):
    source = tables(
        **dimensions(),
        m_barang=[item("1"), item("off", kd_kategori="X")],
        m_barang_satuan=[unit("1", "NOL", 0)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": k, "stok_awal": 5} for k in ("1", "off", "ghost")],
        **split("t_penjualan", [sale("S1", "A", "off", 1), sale("S2", "B", "1", 1), sale("S3", "B", "1", 9, "NOL")]),
        **split("t_pembelian", [purchase("P", "A", "off", 7), purchase("Q", "A", "ghost", 3)]),
    )
    found = {k: float(v) for k, v in rows(stock_per_item(source, WINDOW), "kd_barang", "stok_akhir")}
    assert found == {"1": 4.0, "off": 7.0, "ghost": 3.0}


def test_both_result_sets(tables):
    sets = costing_inputs(tables(), WINDOW)
    assert list(sets) == ["stok_akhir", "histori_masuk"]
    assert all(df.isEmpty() for df in sets.values())
