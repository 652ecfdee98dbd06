"""Valued stock per division and item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.functions.numbers import ZERO_IS_ZERO, to_double
from stockledger.functions.text import or_blank
from stockledger.operators.items import ITEM, division_names, factor_of, item_factors, item_master
from stockledger.operators.movements import (
    HISTORY_POLICY,
    PURCHASE,
    SNAPSHOT_POLICY,
    LedgerPolicy,
    movements,
)
from stockledger.operators.purchases import Purchases, opening_costs, purchases_once
from stockledger.operators.running import Level, running_totals
from stockledger.operators.stock import net_by_unit, net_stock
from stockledger.params import LedgerWindow
from stockledger.sources.base import Source

STOCK = ["server_key", "kd_divisi", "kd_barang"]


def _quantities(
    source: Source, window: LedgerWindow, policy: LedgerPolicy, bought: Purchases
) -> DataFrame:
    """The ledger's quantities; its purchases come from the reading that gives the prices too."""
    others = policy.only(*[b for b in policy.branches if b is not PURCHASE])
    columns = [*STOCK, "kd_satuan", "debet", "kredit"]
    rest = movements(source, window, others).select(*columns)
    return rest.unionByName(bought.quantities(window, policy).select(*columns))


def stock_snapshot(source: Source, window: LedgerWindow) -> DataFrame:
    """Stock of every active item in every division it moved in, with names and prices."""
    bought = purchases_once(source)
    ledger = _quantities(source, window, SNAPSHOT_POLICY, bought)
    items = item_master(source)
    stock = net_stock(
        net_by_unit(ledger, *STOCK).join(item_factors(source).hint("shuffle_hash"), ITEM, "left"),
        factor_of(F.col("kd_satuan")),
        *STOCK,
    )
    zero = F.lit(0)
    # What depends on the item alone is worked out once for each item, not for each of its divisions.
    priced = items.join(bought.prices(), ITEM, "left").select(
        *ITEM,
        or_blank(F.col("nama")).alias("barang"),
        *[or_blank(F.col(c)).alias(c) for c in ("kategori", "merk", "model", "warna", "ukuran")],
        F.coalesce("harga_jual", zero).cast("double").alias("harga_jual"),
        F.coalesce("harga_beli", zero).cast("double").alias("harga_beli_akhir"),
        to_double(F.coalesce("harga_avg", zero), 2).alias("harga_avg"),
    )
    return (
        stock.join(priced.hint("shuffle_hash"), ITEM)
        .join(division_names(source), ["server_key", "kd_divisi"], "left")
        .select(
            "server_key",
            "kd_divisi",
            F.coalesce("divisi", "kd_divisi").alias("divisi"),
            "kd_barang",
            "barang",
            *["kategori", "merk", "model", "warna", "ukuran"],
            F.col("stok").cast("double").alias("stok_akhir"),
            "harga_jual",
            "harga_beli_akhir",
            "harga_avg",
        )
    )


def in_report_order(snapshot: DataFrame) -> DataFrame:
    """By division name, then item name."""
    return snapshot.orderBy("divisi", "barang", "kd_divisi", "kd_barang")


def with_position(snapshot: DataFrame, name: str = "urutan") -> DataFrame:
    """Place of each row of a site in report order, from 1; no site or division is sorted in one task."""
    levels = [Level(or_blank(F.col("divisi"))), Level(or_blank(F.col("barang")))]
    order = [F.col("kd_divisi").asc(), F.col("kd_barang").asc()]
    return running_totals(snapshot, ["server_key"], levels, order, {}, name)


def stock_as_of(source: Source, window: LedgerWindow) -> DataFrame:
    """Stock as one statement gives it: the whole ledger, known divisions only.

    Differs from the snapshot: counts that take out are included, purchases count by
    status, a zero factor stays zero, and the last purchase price falls back to the
    highest opening cost of the item.
    """
    bought = purchases_once(source)
    ledger = _quantities(source, window, HISTORY_POLICY, bought)
    items = item_master(source)
    # The master keeps active categories only, which settles the category rule of the ledger.
    stock = net_stock(
        net_by_unit(ledger, *STOCK, null_is_zero=False).join(item_factors(source), ITEM, "left"),
        factor_of(F.col("kd_satuan"), ZERO_IS_ZERO),
        *STOCK,
    )
    priced = items.join(bought.prices(), ITEM, "left").join(opening_costs(source), ITEM, "left")
    return (
        stock.join(priced, ITEM)
        .join(division_names(source), ["server_key", "kd_divisi"])
        .select(
            "server_key",
            F.col("kd_divisi").alias("Kode Divisi"),
            F.col("divisi").alias("Divisi"),
            F.col("kd_barang").alias("Kode Barang"),
            F.col("nama").alias("Barang"),
            F.col("kategori").alias("Kategori"),
            F.col("merk").alias("Merk"),
            F.col("model").alias("Model"),
            F.col("warna").alias("Warna"),
            F.col("ukuran").alias("Ukuran"),
            F.col("stok").cast("double").alias("Stok Akhir"),
            F.col("harga_jual").cast("double").alias("Harga Jual"),
            F.coalesce("harga_beli", "harga_beli_awal", F.lit(0))
            .cast("double")
            .alias("Harga Beli Akhir"),
        )
    )
