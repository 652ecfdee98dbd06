"""Report exports: one folder of files per report, columns and headings fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.functions import dates
from stockledger.plans import history as H
from stockledger.plans.report import HEADINGS

# Headings of the history report in their order, and the column of each.
HISTORY_HEADINGS = {
    "Kd_Divisi": "kd_divisi",
    "Divisi": "divisi",
    "K.Nota": "kepala_nota",
    "Tanggal": "tanggal",
    "Transaksi": "transaksi",
    "No. Transaksi": "no_transaksi",
    "Kd_Barang": "kd_barang",
    "Barang": "barang",
    "Debet": "debet",
    "Kredit": "kredit",
    "Kd_Satuan": "kd_satuan",
    "Satuan": "satuan",
    "Harga": "harga",
    "Saldo": "saldo",
    "Konversi": "konversi",
}
_NUMBERS = {"debet", "kredit", "harga", "saldo", "konversi"}


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"format is 'csv' or 'parquet', not {fmt!r}")


def stock_export(report: DataFrame) -> DataFrame:
    """The report as exported, by division and item name."""
    return report.orderBy("Divisi", "Barang", "Kode Divisi", "Kode Barang").select(*HEADINGS)


def write_stock_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(stock_export(report), path, fmt)


def history_export(history: H.History, konversi: bool = False) -> DataFrame:
    """History with its running balance in ledger order, optionally in smallest units."""
    balanced = H.with_balance(H.converted(history) if konversi else history)
    shown = []
    for heading, name in HISTORY_HEADINGS.items():
        column = F.col(name)
        if name == "tanggal":
            column = dates.as_text(column)
        elif name in _NUMBERS:
            column = F.round(column, 4).cast("double")
        shown.append(column.alias(heading))
    return H.in_history_order(balanced).select(*shown)


def write_history_report(
    history: H.History, path: str, konversi: bool = False, fmt: str = "csv"
) -> None:
    _write(history_export(history, konversi), path, fmt)
