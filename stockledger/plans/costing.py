"""Inbound cost layers and stock per item, the inputs of a cost calculation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.functions import dates
from stockledger.functions.numbers import NET_QTY, ZERO_IS_ZERO, ratio
from stockledger.functions.prices import net_buy_price
from stockledger.operators.items import (
    ITEM,
    factor_of,
    in_active_category,
    item_cards,
    item_factors,
)
from stockledger.operators.movements import (
    HISTORY_POLICY,
    document_lines,
    movements,
    needs_active_category,
)
from stockledger.operators.stock import net_by_unit, net_stock
from stockledger.params import LedgerWindow
from stockledger.sources.base import Source

HEADER_DISCOUNTS = [f"h_diskon{i}" for i in range(1, 5)]
LINE_DISCOUNTS = [f"diskon{i}" for i in range(1, 5)]
LAYER = ["server_key", "kd_barang", "tanggal", "jenis", "stok", "harga"]


def stock_per_item(source: Source, window: LedgerWindow) -> DataFrame:
    """Stock of each item over all divisions by the end of the as-of day."""
    ledger = movements(source, window, HISTORY_POLICY).withColumn("gated", needs_active_category())
    by_unit = net_by_unit(ledger, *ITEM, "gated", null_is_zero=False)
    carded = in_active_category(by_unit.join(item_cards(source), ITEM, "left"), F.col("gated"))
    return net_stock(carded, factor_of(F.col("kd_satuan"), ZERO_IS_ZERO), *ITEM).withColumnRenamed(
        "stok", "stok_akhir"
    )


def opening_layer(source: Source, window: LedgerWindow) -> DataFrame:
    """Opening stock per item, at the mean cost of the divisions that hold some."""
    held = F.when(F.col("stok_awal") > 0, F.col("harga_beli_awal"))
    sums = (
        source.table("m_barang_divisi")
        .groupBy(*ITEM)
        .agg(
            F.sum(F.coalesce("stok_awal", F.lit(0))).alias("stok"),
            F.sum(held).alias("cost"),
            F.count(held).alias("costed"),
        )
    )
    mean = F.when(F.col("costed") > 0, ratio(F.col("cost"), F.col("costed"), 6)).otherwise(F.lit(0))
    return sums.select(
        *ITEM,
        dates.moment(window.closing_ts).alias("tanggal"),
        F.lit("STOK_AWAL").alias("jenis"),
        F.col("stok").cast("double").alias("stok"),
        mean.cast("double").alias("harga"),
    )


def count_layers(source: Source, window: LedgerWindow) -> DataFrame:
    """Counts that add stock, without a price."""
    rows = source.table("t_opname_stok").where(
        (F.col("status") == 2) & dates.in_days(F.col("tanggal"), window.closing_ts, window.as_of)
    )
    qty = F.col("qty").cast(NET_QTY) * factor_of(F.col("kd_satuan"), ZERO_IS_ZERO)
    return rows.join(item_factors(source), ITEM, "left").select(
        *ITEM,
        "tanggal",
        F.lit("OPNAME").alias("jenis"),
        qty.cast("double").alias("stok"),
        F.lit(0.0).alias("harga"),
    )


def purchase_layers(source: Source, window: LedgerWindow | None = None) -> DataFrame:
    """One layer per purchase line, with its net price per smallest unit.

    The closing day belongs to the layers, unlike to the stock. Without a window all
    purchases are priced.
    """
    header = source.table("t_pembelian")
    if window is not None:
        header = header.where(dates.in_days(F.col("tanggal"), window.closing_ts, window.as_of))
    header = header.select(
        "server_key",
        "no_transaksi",
        "tanggal",
        "pajak",
        "ppnbm",
        *[F.col(f"diskon{i}").alias(f"h_diskon{i}") for i in range(1, 5)],
    )
    lines = source.table("t_pembelian_detail").join(header, ["server_key", "no_transaksi"])
    factor = factor_of(F.col("kd_satuan"), ZERO_IS_ZERO)
    harga = net_buy_price(
        F.col("harga_beli"),
        [F.col(c) for c in LINE_DISCOUNTS],
        [F.col(c) for c in HEADER_DISCOUNTS],
        F.col("pajak"),
        F.col("ppnbm"),
        factor,
    )
    return lines.join(item_factors(source), ITEM, "left").select(
        "server_key",
        "no_transaksi",
        "line_no",
        "kd_barang",
        "kd_satuan",
        "tanggal",
        F.lit("PEMBELIAN").alias("jenis"),
        (F.col("qty").cast(NET_QTY) * factor).cast("double").alias("stok"),
        harga.alias("harga"),
    )


def inbound_layers(source: Source, window: LedgerWindow) -> DataFrame:
    """Everything that brought an item in, as (date, kind, quantity, price)."""
    parts = [
        opening_layer(source, window),
        count_layers(source, window),
        purchase_layers(source, window).select(*LAYER),
    ]
    return reduce(DataFrame.unionByName, parts)


def costing_inputs(source: Source, window: LedgerWindow) -> dict[str, DataFrame]:
    """Both result sets a cost calculation starts from."""
    return {
        "stok_akhir": stock_per_item(source, window),
        "histori_masuk": inbound_layers(source, window),
    }
