"""Search, valuation and summaries over a stock snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions.numbers import NET_QTY, or_default, ratio, to_double
from stockledger.functions.prices import nominal
from stockledger.functions.text import like_pattern

# Headings of the stock report in their order, and the snapshot column of each.
HEADINGS = {
    "Kode Divisi": "kd_divisi",
    "Divisi": "divisi",
    "Kode Barang": "kd_barang",
    "Barang": "barang",
    "Kategori": "kategori",
    "Merk": "merk",
    "Model": "model",
    "Warna": "warna",
    "Ukuran": "ukuran",
    "Stok Akhir": "stok_akhir",
    "Harga Average": "harga_avg",
    "Harga Jual": "harga_jual",
    "Nominal": "nominal",
    "Harga Beli Akhir": "harga_beli_akhir",
}


def search_filter(
    kode: str | None = None, nama: str | None = None, divisi: str | None = None
) -> Column:
    """Code or name pattern, and the division's name ignoring case."""
    wanted = F.lit(True)
    if kode or nama:
        hits = [
            like_pattern(F.col(column), pattern)
            for column, pattern in (("kd_barang", kode), ("barang", nama))
            if pattern
        ]
        wanted = hits[0] if len(hits) == 1 else hits[0] | hits[1]
    if divisi:
        wanted = wanted & (F.lower("divisi") == divisi.lower())
    return wanted


def search(
    snapshot: DataFrame,
    kode: str | None = None,
    nama: str | None = None,
    divisi: str | None = None,
) -> DataFrame:
    return snapshot.where(search_filter(kode, nama, divisi))


def stock_report(snapshot: DataFrame) -> DataFrame:
    """The fourteen display columns; stock valued at average or last purchase price."""
    value = nominal(F.col("stok_akhir"), F.col("harga_avg"), F.col("harga_beli_akhir"))
    average = to_double(F.col("harga_avg").cast(NET_QTY), 2)
    columns = {"nominal": value.cast("double"), "harga_avg": average}
    return snapshot.select(
        "server_key",
        *[columns.get(name, F.col(name)).alias(heading) for heading, name in HEADINGS.items()],
    )


def kpi_summary(report: DataFrame) -> DataFrame:
    """Item count, total value, mean stock and divisions of a report, in one row.

    Rows are first combined per division, so the only values brought together at the
    end are one per division. A missing division name counts as a division of its own.
    """
    per_division = report.groupBy("Divisi").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.col("Nominal").cast("decimal(28,2)")).alias("value"),
        F.sum(F.col("Stok Akhir").cast(NET_QTY)).alias("stock"),
    )
    none = F.lit(0)
    mean = F.when(F.col("items") > 0, ratio(F.col("stock"), F.col("items"), 2)).otherwise(none)
    return per_division.agg(
        F.coalesce(F.sum("items"), none).alias("items"),
        F.coalesce(F.sum("value"), none).alias("value"),
        F.sum("stock").alias("stock"),
        F.count(F.lit(1)).alias("divisi_count"),
        F.array_join(F.sort_array(F.collect_list("Divisi")), ", ").alias("divisi_list"),
    ).select(
        F.col("items").cast("bigint").alias("total_items"),
        F.col("value").cast("double").alias("total_nominal"),
        "divisi_count",
        mean.cast("double").alias("avg_stok"),
        "divisi_list",
    )


def low_stock(report: DataFrame, min_stok: float = 10) -> DataFrame:
    """Rows with some stock left, but less than the threshold."""
    stok = or_default(F.col("Stok Akhir"), 0.0)
    return report.where((stok > 0) & (stok < min_stok))
