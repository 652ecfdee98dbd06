from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stockledger.plans import history as H
from stockledger.sinks.reports import HISTORY_HEADINGS, history_export, write_history_report
from tests.conftest import CLOSING, dimensions, item, purchase, rows, sale, split, unit


@pytest.fixture(scope="module")
def source(tables):
    opname = [
        {"no_transaksi": "O1", "kd_divisi": "B", "kd_barang": "1", "qty": 4, "kd_satuan": "PCS",
         "tanggal": "2024-02-10 08:00:00", "status": 2},
        {"no_transaksi": "O2", "kd_divisi": "A", "kd_barang": "1", "qty": 1, "kd_satuan": None,
         "tanggal": "2024-02-10 08:00:00", "status": 0},
    ]
    return tables(
        **dimensions(),
        m_barang=[item("1"), item("off", kd_kategori="X"), item("two")],
        m_barang_satuan=[
            unit("1", "PCS", 1), unit("1", "BOX", 12), unit("1", "NOL", 0),
            unit("two", "PCS", 1), unit("two", "BOX", 1), unit("off", "PCS", 1),
        ],
        m_barang_divisi=[
            {"kd_divisi": d, "kd_barang": k, "stok_awal": 10, "harga_beli_awal": 3}
            for d, k in (("A", "1"), ("B", "1"), ("A", "off"), ("A", "two"), ("A", "bare"))
        ],
        t_opname_stok=opname,
        t_mutasi_stok=[{"no_transaksi": "M", "kd_divisi_asal": "A", "kd_divisi_tujuan": "B",
                        "tanggal": "2024-02-03 00:00:00"}],
        t_mutasi_stok_detail=[{"no_transaksi": "M", "kd_barang": "1", "qty": 1, "kd_satuan": "BOX"}],
        t_penjualan_retur=[{"no_retur": "R", "kd_divisi": "Z", "tanggal": "2024-02-20 10:00:00"}],
        t_penjualan_retur_detail=[{"no_retur": "R", "kd_barang": "1", "qty": 2, "kd_satuan": "NOL",
                                   "harga_jual": None}],
        t_pembelian_retur=[{"no_retur": "K", "kd_divisi": "A", "tanggal": "2024-02-10 08:00:00"}],
        t_pembelian_retur_detail=[{"no_retur": "K", "kd_barang": "1", "qty": 3, "kd_satuan": "PCS",
                                   "harga": 6}],
        **split("t_penjualan", [sale("S1", "A", "1", 2, "BOX"), sale("S2", "A", "off", 1)]),
        **split("t_pembelian", [
            purchase("P1", "A", "1", 5, "BOX", tanggal="2024-02-10 08:00:00"),
            purchase("P2", "A", "1", 7, status=2), purchase("P3", "A", "off", 1),
        ]),
    )


EXPORT_ORDER = [
    ("A", "Stok Awal", 10, 0), ("A", "Mutasi Keluar", 0, 1), ("A", "Opname Keluar", 0, 1),
    ("A", "Pembelian", 5, 0), ("A", "Retur Pembelian", 0, 3), ("A", "Penjualan", 0, 2),
    ("B", "Stok Awal", 10, 0), ("B", "Mutasi Masuk", 1, 0), ("B", "Opname Masuk", 4, 0),
    ("Z", "Retur Penjualan Dengan Nota", 2, 0),
]


def listed(df, *columns):
    return [tuple(r) for r in df.orderBy("no").select(*columns).collect()]


def test_ledger_order_and_balance_run_on_over_divisions(source):
    found = H.with_balance(H.movement_history(source, CLOSING, items=["1"]))
    saldo, expected = 0, []
    for division, kind, debet, kredit in EXPORT_ORDER:
        saldo += debet - kredit
        expected.append((division, kind, debet, kredit, saldo))
    assert listed(found, "kd_divisi", "transaksi", "debet", "kredit", "saldo") == expected


def test_balance_reset_per_division(source):
    found = H.with_balance(H.movement_history(source, CLOSING, items=["1"]), reset_per_division=True)
    last = found.groupBy("kd_divisi").agg(F.max_by("saldo", "no").cast("int"))
    assert rows(last) == [("A", 8), ("B", 15), ("Z", 2)]


def test_conversion_and_label(source):
    plain = H.movement_history(source, CLOSING, items=["1"])
    found = H.converted(plain)
    shown = found.rows()
    assert rows(shown.where("transaksi = 'Penjualan'"), "kredit", "satuan") == [(24, "Box (Conv)")]
    assert rows(shown.where("transaksi = 'Retur Pembelian'"), "kredit", "satuan") == [(3, "Pieces")]
    assert rows(H.totals(found), "total_debet", "total_kredit", "saldo_akhir") == [(98.0, 40.0, 58.0)]
    assert rows(H.totals(plain), "saldo_akhir") == [(25.0,)]


def test_last_balance_equals_totals(source):
    history = H.converted(H.movement_history(source, CLOSING))
    for shaped in (H.with_balance, H.with_balance_by_date):
        last = shaped(history).groupBy("kd_barang").agg(F.max_by("saldo", "no").cast("double"))
        assert rows(last) == rows(H.totals(history), "kd_barang", "saldo_akhir")


def test_by_date_order(source):
    history = H.movement_history(source, CLOSING, items=["1"])
    up = listed(H.with_balance_by_date(history), "kd_divisi", "transaksi")
    assert up[:4] == [("A", "Stok Awal"), ("B", "Stok Awal"), ("A", "Mutasi Keluar"), ("B", "Mutasi Masuk")]
    down = listed(H.with_balance_by_date(history, ascending=False), "kd_divisi", "transaksi")
    assert down[0][0] == "Z" and down[-1] == ("B", "Stok Awal")


def test_range_drops_the_opening_row(source):
    ranged = H.movement_history(source, CLOSING, items=["1"], start="2024-02-03", end="2024-02-09")
    assert listed(H.with_balance(ranged), "transaksi", "saldo") == [("Mutasi Keluar", -1), ("Mutasi Masuk", 0)]
    on_closing = H.movement_history(source, CLOSING, items=["1"], start="2024-01-31", end="2024-01-31")
    assert rows(on_closing.rows(), "transaksi", "kd_divisi") == [("Stok Awal", "A"), ("Stok Awal", "B")]


def test_items_and_divisions(source):
    history = H.movement_history(source, CLOSING, items=["1", "two"], divisions=["B", "A"])
    assert rows(history.rows().select("kd_barang", "kd_divisi").distinct()) == [("1", "A"), ("1", "B"), ("two", "A")]


def test_category_gates_opening_and_sales_only(source):
    found = H.movement_history(source, CLOSING, items=["off", "bare"])
    assert rows(found.rows(), "kd_barang", "transaksi") == [("off", "Pembelian")]


def test_unknown_names_are_blank_or_dropped(source):
    history = H.movement_history(source, CLOSING, items=["1"])
    assert rows(history.rows().where("kd_divisi = 'Z'"), "divisi", "kepala_nota", "satuan", "harga") == [("", "", "", 0)]
    known = H.movement_history(source, CLOSING, known_only=True).rows()
    assert rows(known.where("kd_divisi = 'Z'")) == []
    assert "Retur Penjualan Dengan Nota" not in {r.transaksi for r in known.collect()}


def test_opening_unit(source):
    def opening(units):
        found = H.movement_history(source, CLOSING, items=["two"], opening_units=units)
        return rows(found.rows(), "transaksi", "kd_satuan")

    assert opening("first") == [("Stok Awal", "BOX")]
    assert opening("each") == [("Stok Awal", "BOX"), ("Stok Awal", "PCS")]
    each = H.movement_history(source, CLOSING, items=["1"], opening_units="each")
    assert each.rows().count() == len(EXPORT_ORDER)


def test_unit_names_and_filter(source):
    history = H.movement_history(source, CLOSING, items=["1"])
    assert rows(H.unit_names(history), "satuan") == [("Box",), ("Pieces",)]
    assert H.with_unit(history, "ALL").rows().count() == len(EXPORT_ORDER)
    assert H.with_unit(history, "Box").rows().count() == 4


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("column", ["kd_satuan", "debet", "no_transaksi", "tanggal", "no", "saldo"])
def test_sorting_by_any_column(source, column, ascending):
    history = H.with_balance(H.movement_history(source, CLOSING, items=["1"]))
    found = H.sorted_history(history.drop("saldo"), column, ascending)
    data = [r.asDict() for r in history.orderBy("no").collect()]
    if column == "saldo":
        expected = data
    else:
        valued = [r for r in data if r[column] is not None]
        expected = sorted(valued, key=lambda r: r[column], reverse=not ascending)
        if not ascending:  # Python's reverse keeps the order of equal rows, as does the rule.
            assert [r["no"] for r in expected if r[column] == expected[0][column]] == sorted(
                r["no"] for r in expected if r[column] == expected[0][column]
            )
        expected += [r for r in data if r[column] is None]
    got = [r.asDict() for r in found.orderBy("urutan").collect()]
    assert [r["no"] for r in got] == [r["no"] for r in expected]
    saldo = 0
    for r in got:
        saldo += r["debet"] - r["kredit"]
        assert r["saldo"] == saldo


def test_null_dates_sort_first(spark, source):
    history = H.movement_history(source, CLOSING, items=["1"])
    dated = F.when(F.col("transaksi") != "Penjualan", F.col("tanggal"))
    undated = replace(history, ledger=history.ledger.withColumn("tanggal", dated))
    assert listed(H.with_balance(undated), "transaksi")[0] == ("Penjualan",)
    assert listed(H.with_balance_by_date(undated), "transaksi")[0] == ("Penjualan",)
    assert listed(H.with_balance_by_date(undated, ascending=False), "transaksi")[-1] == ("Penjualan",)


def test_export(spark, source, tmp_path):
    history = H.movement_history(source, CLOSING, items=["1"])
    export = history_export(history, konversi=True)
    assert export.columns == list(HISTORY_HEADINGS)
    got = [tuple(r) for r in export.select("Kd_Divisi", "Transaksi").collect()]
    assert got == [r[:2] for r in EXPORT_ORDER]
    write_history_report(history, str(tmp_path / "h"))
    read = spark.read.option("header", True).csv(str(tmp_path / "h"))
    assert read.columns == list(HISTORY_HEADINGS) and read.count() == len(EXPORT_ORDER)
