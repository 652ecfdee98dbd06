"""Prices derived from purchases, and the purchases of a ledger, from one reading of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions import dates
from stockledger.functions.numbers import ratio
from stockledger.operators.items import ITEM
from stockledger.operators.movements import PURCHASE, ZERO, LedgerPolicy
from stockledger.operators.sharing import naming, unnamed
from stockledger.params import LedgerWindow
from stockledger.sources.base import Source

_UNDATED = "0001-01-01"


@dataclass(frozen=True)
class Purchases:
    """All purchase lines with their headers, dealt by item and moment.

    Header and lines are joined once and the joined lines shuffled once, on a key that no
    item is hot under; what is summed up of them reads that shuffle. Lines without an item
    are left out. A line without a header is known to the average price only.
    """

    lines: DataFrame

    def _grouped(self, keys: list[str], *sums: Column) -> DataFrame:
        return unnamed(self.lines.groupBy(*keys).agg(*sums, naming(*self.lines.columns)))

    def quantities(self, window: LedgerWindow, policy: LedgerPolicy) -> DataFrame:
        """What the lines of a ledger come to per division, item and unit, as movements."""
        counts = F.col("known") & dates.in_window(F.col("tanggal"), window)
        ingested = dates.ingest_bounds(F.col("tanggal_server"), window)
        if ingested is not None:
            counts = counts & ingested
        if policy.purchase_status is not None:
            counts = counts & F.col("status").isin(*policy.purchase_status)
        summed = self._grouped(
            ["server_key", "kd_divisi", "kd_barang", "kd_satuan"],
            F.sum(F.when(counts, F.col("qty"))).alias("debet"),
            F.count(F.when(counts, 1)).alias("n"),
        )
        return summed.where("n > 0").drop("n").withColumn("kredit", F.expr(ZERO))

    def prices(self) -> DataFrame:
        """Average price of each item, and price of its latest purchase (null without one).

        The latest moment of an item is a maximum, which combines before the shuffle; which
        of the lines of that moment is the latest is asked of those lines only.
        """
        known = F.when(F.col("known"), F.col("moment"))
        totals = self._grouped(
            ITEM,
            F.max(known).alias("moment"),
            F.sum(F.col("qty") * F.col("harga_beli")).alias("amount"),
            F.sum("qty").alias("qty"),
        )
        order = F.struct("tanggal", "no_transaksi", "line_no", "kd_satuan", "qty", "harga_beli")
        latest = totals.select(*ITEM, "moment")
        last = Purchases(self.lines.join(latest, [*ITEM, "moment"]))._grouped(
            ITEM, F.max_by("harga_beli", F.when(F.col("known"), order)).alias("harga_beli")
        )
        price = F.when(F.col("qty") > 0, ratio(F.col("amount"), F.col("qty"), 6)).otherwise(F.lit(0))
        bought = F.col("moment").isNotNull().alias("bought")
        return totals.select(*ITEM, price.alias("harga_avg"), bought).join(last, ITEM, "left")


def purchases_once(source: Source) -> Purchases:
    heads = source.table(PURCHASE.table).select(
        "server_key", "no_transaksi", "tanggal", "tanggal_server", "kd_divisi", "status", F.lit(True).alias("known")
    )
    lines = source.table(f"{PURCHASE.table}_detail").select(
        "server_key", "no_transaksi", "line_no", "kd_barang", "kd_satuan", "qty", "harga_beli"
    )
    joined = lines.where("kd_barang IS NOT NULL").join(heads, ["server_key", "no_transaksi"], "left")
    known = joined.withColumns(
        {
            "known": F.coalesce("known", F.lit(False)),
            "moment": F.coalesce("tanggal", dates.day_start(_UNDATED)),
        }
    )
    present = F.col("server_key").isNotNull() & F.col("moment").isNotNull()
    # The one site of a source is a constant, which no join takes for a key; dealt by it too, all lines would be shuffled again for that join.
    dealt = ITEM if source.server_key is None else ["kd_barang"]
    return Purchases(known.where(present).repartition(*dealt, "moment"))


def last_buy_price(source: Source) -> DataFrame:
    """Price of the latest purchase of each item, whatever its date or status.

    Ties of the moment go to the later document number, then line; an undated purchase
    comes before all dated ones.
    """
    return purchases_once(source).prices().where("bought").select(*ITEM, "harga_beli")


def weighted_average_price(source: Source) -> DataFrame:
    """Quantity-weighted purchase price, 0 unless the summed quantity is positive."""
    sums = (
        source.table("t_pembelian_detail")
        .groupBy(*ITEM)
        .agg(
            F.sum(F.col("qty") * F.col("harga_beli")).alias("amount"),
            F.sum("qty").alias("qty"),
        )
    )
    price = F.when(F.col("qty") > 0, ratio(F.col("amount"), F.col("qty"), 6)).otherwise(F.lit(0))
    return sums.select(*ITEM, price.alias("harga_avg"))


def opening_costs(source: Source) -> DataFrame:
    """Highest opening cost of each item over its divisions."""
    return (
        source.table("m_barang_divisi")
        .groupBy(*ITEM)
        .agg(F.max("harga_beli_awal").alias("harga_beli_awal"))
    )
