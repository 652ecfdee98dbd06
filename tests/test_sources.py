import pytest
from pyspark.sql import functions as F

from stockledger import schemas
from stockledger.params import LedgerWindow
from stockledger.plans.snapshot import stock_snapshot
from stockledger.session import shared_dir
from stockledger.sources import (
    AllSites, CatalogSource, FrameSource, JdbcSource, ParquetSource, run_statement, run_statements,
)
from tests.conftest import CLOSING, dimensions, item, rows, sale, split, unit

WINDOW = LedgerWindow(CLOSING, "2024-03-31")


@pytest.fixture(scope="module")
def site(tables):
    return tables(
        **dimensions(), m_barang=[item("1")], m_barang_satuan=[unit("1", "PCS", 1)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 5}],
        **split("t_penjualan", [sale("S", "A", "1", 2)]),
    )


def test_a_missing_table_is_an_error_unless_it_may_be_empty(spark, site):
    strict = FrameSource(spark, {}, "main")
    with pytest.raises(FileNotFoundError):
        strict.table("m_divisi")
    lenient = FrameSource(spark, {}, "main", on_missing="empty")
    assert lenient.table("m_divisi").isEmpty()
    assert list(lenient.missing) == ["m_divisi"]
    with pytest.raises(FileNotFoundError):
        lenient.table("m_barang")


def test_a_source_without_a_column_is_reported(spark):
    frame = spark.createDataFrame([("1",)], "kd_divisi string")
    with pytest.raises(ValueError, match="nama"):
        FrameSource(spark, {"m_divisi": frame}).table("m_divisi")
    lenient = FrameSource(spark, {"m_divisi": frame}, on_missing="empty")
    assert lenient.table("m_divisi").isEmpty() and "nama" in lenient.missing["m_divisi"]


def test_columns_are_cast_and_optional_ones_filled(spark):
    frame = spark.createDataFrame([(1, "B", 2.5, "PCS")], "no_transaksi int, kd_barang string, qty double, kd_satuan string")
    table = FrameSource(spark, {"t_mutasi_stok_detail": frame}, "o'site").table("t_mutasi_stok_detail")
    assert dict(table.dtypes) == schemas.TABLES["t_mutasi_stok_detail"]
    row = table.first()
    assert (row.server_key, row.no_transaksi, row.line_no) == ("o'site", "1", None)


def _write(site, root, keys):
    for name in schemas.TABLES:
        for key in keys:
            rows_of = site.table(name).withColumn("server_key", F.lit(key))
            rows_of.write.mode("append").partitionBy("server_key").parquet(f"{root}/{name}")


def test_parquet_sites(spark, site, tmp_path):
    root = str(tmp_path / "lake")
    _write(site, root, ["n", "s"])
    one = ParquetSource(spark, root, "n")
    assert rows(stock_snapshot(one, WINDOW), "server_key", "stok_akhir") == [("n", 3.0)]
    plan = one.table("t_penjualan")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(server_key" in plan
    every = [("n", 3.0), ("s", 3.0)]
    assert rows(stock_snapshot(ParquetSource(spark, root), WINDOW), "server_key", "stok_akhir") == every
    union = AllSites([ParquetSource(spark, root, k) for k in ("n", "s")])
    assert union.available() == ["n", "s"] and union.exists("m_barang")
    assert rows(stock_snapshot(union, WINDOW), "server_key", "stok_akhir") == every
    with pytest.raises(FileNotFoundError):
        ParquetSource(spark, str(tmp_path / "nowhere")).table("m_divisi")


def test_catalog_tables_bucketed_by_document_join_without_a_shuffle(spark, site):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for name in schemas.TABLES:
        writer = site.table(name).write.mode("overwrite").format("parquet")
        if name.startswith("t_penjualan") and "retur" not in name:
            writer = writer.bucketBy(4, "server_key", "no_transaksi").sortBy("server_key", "no_transaksi")
        writer.saveAsTable(f"shop.{name}")
    shop = CatalogSource(spark, "shop")
    assert shop.exists("t_penjualan") and not shop.exists("nothing")
    assert rows(stock_snapshot(shop, WINDOW), "stok_akhir") == [(3.0,)]
    from stockledger.operators.movements import SALE, SNAPSHOT_POLICY, movements

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = movements(shop, WINDOW, SNAPSHOT_POLICY.only(SALE))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan.toString() and "Exchange" not in plan.toString()


def test_jdbc_options(spark):
    split_by = {"t_penjualan": {"partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}}
    source = JdbcSource(spark, {"url": "jdbc:x", "fetchsize": "5"}, "n", split_by, schema="dbo")
    assert source.reader_options("t_penjualan") == {
        "url": "jdbc:x", "fetchsize": "5", "dbtable": "dbo.t_penjualan", **split_by["t_penjualan"],
    }
    assert source.reader_options("m_divisi")["dbtable"] == "dbo.m_divisi"


def test_statements(site):
    by_position = run_statement(site, "SELECT nama FROM {m_divisi} WHERE kd_divisi = ?", ["B"])
    assert rows(by_position) == [("Div B",)]
    sets = run_statements(
        site,
        {"divisi": "SELECT count(*) AS n FROM {m_divisi} WHERE kd_divisi >= :k",
         "satuan": "SELECT kd_satuan FROM {m_satuan} WHERE kd_satuan > :k"},
        {"k": "B"},
    )
    assert rows(sets["divisi"]) == [(1,)] and rows(sets["satuan"]) == [("BOX",), ("PCS",)]
    assert rows(run_statement(site, "SELECT count(*) AS n FROM {m_satuan}")) == [(2,)]


def test_item_filter_reaches_every_scan(spark, tables, tmp_path):
    from stockledger.operators.movements import HISTORY_POLICY, movements

    when = {"tanggal": "2024-02-02 00:00:00"}
    documents = {name: [when] for name in schemas.TABLES if name.startswith("t_")}
    documents |= {name: [{"kd_barang": "1"}] for name in schemas.TABLES if name.endswith("_detail")}
    full = tables(**documents, m_barang_divisi=[{"kd_barang": "1"}])
    root = str(tmp_path / "lake")
    _write(full, root, ["n"])
    ledger = movements(ParquetSource(spark, root, "n"), LedgerWindow(CLOSING), HISTORY_POLICY, ["1"])
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    details = [line for line in plan.splitlines() if "FileScan" in line and "kd_barang" in line]
    assert len(details) == 7
    assert all("EqualTo(kd_barang,1)" in line for line in details)
    headers = [line for line in plan.splitlines() if "FileScan" in line and "tanggal" in line.split("]")[0]]
    assert headers and all("GreaterThan(tanggal" in line for line in headers)


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_table_with_a_corrupt_file_counts_as_empty_and_names_it(spark, site, tmp_path):
    _write(site, str(tmp_path), ["main"])
    lines = tmp_path / "t_penjualan_detail" / "server_key=main"
    (lines / "part-1.parquet").write_bytes(b"no parquet")
    (lines / "part-2.parquet").write_bytes(b"")
    lenient = ParquetSource(spark, str(tmp_path), "main", on_missing="empty")
    assert lenient.table("t_penjualan_detail").isEmpty() and not lenient.table("t_penjualan").isEmpty()
    assert list(lenient.missing) == ["t_penjualan_detail"]
    assert "part-1.parquet" in lenient.missing["t_penjualan_detail"]
    # An empty table and a table of sound files are no failures.
    assert lenient.unreadable("t_mutasi_stok") == [] and lenient.unreadable("m_divisi") == []
    with pytest.raises(Exception, match="part-"):
        ParquetSource(spark, str(tmp_path), "main").table("t_penjualan_detail").collect()
