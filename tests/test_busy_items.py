"""Histories of busy items are cut into chunks, those of other items are one chunk each; the rows are the same."""

import pytest

from stockledger.operators import running
from stockledger.plans import history as H
from tests.conftest import CLOSING, dimensions, item, sale, split, unit


@pytest.fixture()
def source(tables):
    sales = [
        sale(f"S{i}", "AB"[i % 2], "13"[i % 3 == 0], i, ("BOX", "PCS", None)[i % 3], tanggal=f"2024-03-0{1 + i % 4} 10:00:00")
        for i in range(1, 9)
    ]
    return tables(
        **dimensions(),
        m_barang=[item("1"), item("3")],
        m_barang_satuan=[unit("1", "PCS", 1), unit("1", "BOX", 12), unit("3", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 10, "harga_beli_awal": 3}],
        **split("t_penjualan", sales),
    )


SHAPES = [
    lambda h: H.with_balance(h),
    lambda h: H.with_balance(h, True),
    lambda h: H.with_balance_by_date(h, False),
    lambda h: H.sorted_history(H.numbered(H.converted(h)), "debet", False),
    lambda h: H.sorted_history(H.numbered(h), "tanggal"),
    lambda h: H.sorted_history(H.numbered(h), "saldo"),
]


@pytest.mark.parametrize("shape", SHAPES)
def test_cut_or_not(source, monkeypatch, shape):
    def rows():
        found = shape(H.movement_history(source, CLOSING))
        return sorted(map(str, found.drop(H.BUSY_ITEM).collect()))

    calm = rows()
    monkeypatch.setattr(running, "BUSY", 4)  # Item 1 is busy, item 3 is not.
    assert calm == rows() and len(calm) == 9


def test_calm_items_are_not_cut(source):
    """Nothing is gathered, windowed or joined for each day of an item that is not busy."""
    found = H.sorted_history(H.numbered(H.movement_history(source, CLOSING)), "tanggal")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(__class" not in plan and "__count" not in plan and "percentile" not in plan
