import pytest

from stockledger import schemas
from stockledger.plans.report import HEADINGS, kpi_summary, low_stock, search, stock_report
from stockledger.sinks.reports import stock_export, write_stock_report
from tests.conftest import rows


def snapshot(spark, *items: dict):
    base = {"server_key": "main", "kd_divisi": "A", "divisi": "Toko A", "kd_barang": "1", "barang": "x",
            "stok_akhir": 1.0, "harga_jual": 1.0, "harga_beli_akhir": 0.0, "harga_avg": 0.0}
    data = [tuple({**base, **i}.get(c) for c in schemas.SNAPSHOT) for i in items]
    return spark.createDataFrame(data, schemas.ddl(schemas.SNAPSHOT))


NAMES = ["ab", "abc", "cab", "a_b", "axb", "a%b", "", None, "AB"]


def matches(pattern: str, name: str | None) -> bool:
    """The rule, spelled out independently."""
    value, wanted = (name or "").lower(), pattern.lower()
    if not wanted:
        return True
    if wanted == "%":
        return True
    head, tail = wanted[:1] == "%", wanted[-1:] == "%"
    text = wanted[1 if head else 0 : len(wanted) - (1 if tail else 0)]
    if head and tail:
        return text in value
    return value.startswith(text) if tail else value.endswith(text) if head else value == text


@pytest.mark.parametrize("pattern", ["ab%", "%ab", "%ab%", "ab", "%", "%%", "", "a_b", "a%b", "AB%", "%_%"])
def test_patterns(spark, pattern):
    found = search(snapshot(spark, *[{"barang": n, "kd_barang": str(i)} for i, n in enumerate(NAMES)]),
                   nama=pattern)
    expected = sorted(str(i) for i, n in enumerate(NAMES) if matches(pattern, n))
    assert [k for (k,) in rows(found, "kd_barang")] == expected


def test_search_combines_code_or_name_and_division(spark):
    data = snapshot(
        spark,
        {"kd_barang": "10", "barang": "red", "divisi": "North"},
        {"kd_barang": "20", "barang": "blue", "divisi": "NORTH"},
        {"kd_barang": "11", "barang": "blue", "divisi": "south"},
        {"kd_barang": "30", "barang": "green", "divisi": "north"},
    )
    assert rows(search(data, kode="1%", nama="blue"), "kd_barang") == [("10",), ("11",), ("20",)]
    assert rows(search(data, kode="1%", nama="blue", divisi="north"), "kd_barang") == [("10",), ("20",)]
    assert rows(search(data, divisi="NoRTH"), "kd_barang") == [("10",), ("20",), ("30",)]
    assert search(data).count() == 4


@pytest.mark.parametrize(
    ("stok", "avg", "beli", "nominal"),
    [(3, 2.5, 9, 7.5), (3, 0, 9, 27), (3, None, 9, 27), (-2, 1.25, 9, -2.5), (0, 5, 9, 0),
     (0.5, 0.01, 9, 0.01), (-0.5, 0.01, 9, -0.01), (3, 0, 0, 0), (1.005, 1, 0, 1.01)],
)
def test_valuation(spark, stok, avg, beli, nominal):
    data = snapshot(spark, {"stok_akhir": float(stok), "harga_beli_akhir": float(beli),
                            "harga_avg": None if avg is None else float(avg)})
    assert rows(stock_report(data), "Nominal") == [(nominal,)]


def test_summary(spark):
    report = stock_report(snapshot(
        spark,
        {"divisi": "b", "stok_akhir": 2.0, "harga_avg": 3.0},
        {"divisi": "a", "stok_akhir": -1.0, "harga_avg": 3.0},
        {"divisi": "b", "stok_akhir": 3.0, "harga_beli_akhir": 1.5},
    ))
    assert rows(kpi_summary(report)) == [(3, 7.5, 2, 1.33, "a, b")]


def test_summary_of_nothing(spark):
    assert rows(kpi_summary(stock_report(snapshot(spark).limit(0)))) == [(0, 0.0, 0, 0.0, "")]


def test_a_missing_division_name_counts(spark):
    report = stock_report(snapshot(spark, {"divisi": None}, {"divisi": "a"}))
    assert rows(kpi_summary(report), "divisi_count") == [(2,)]


def test_low_stock_bounds(spark):
    stocks = [-1.0, 0.0, 0.5, 9.9999, 10.0, None]
    report = stock_report(snapshot(spark, *[{"stok_akhir": s} for s in stocks]))
    assert rows(low_stock(report), "`Stok Akhir`") == [(0.5,), (9.9999,)]
    assert rows(low_stock(report, 1), "`Stok Akhir`") == [(0.5,)]


def test_export_has_the_fixed_headings_and_order(spark, tmp_path):
    report = stock_report(snapshot(spark, {"divisi": "b"}, {"divisi": "a", "barang": "z"},
                                   {"divisi": "a", "barang": "y"}))
    assert stock_export(report).columns == list(HEADINGS)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_stock_report(report, path, fmt)
        read = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
        assert rows(read, "Divisi", "Barang") == [("a", "y"), ("a", "z"), ("b", "x")]
    with pytest.raises(ValueError):
        write_stock_report(report, str(tmp_path / "x"), "xlsx")
