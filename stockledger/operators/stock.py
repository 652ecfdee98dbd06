"""Net stock: quantities in minus quantities out, in smallest units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions.numbers import NET_QTY


def net_by_unit(ledger: DataFrame, *keys: str, null_is_zero: bool = True) -> DataFrame:
    """Net quantity per key and unit.

    All lines of a unit share one factor, so they are summed before the unit's factor is
    looked up. Rows shrink to (keys x units) on the map side, and no later join or
    shuffle sees a group that grows with the number of documents.
    """
    debet, kredit = F.col("debet"), F.col("kredit")
    if null_is_zero:
        debet, kredit = F.coalesce(debet, F.lit(0)), F.coalesce(kredit, F.lit(0))
    return ledger.groupBy(*keys, "kd_satuan").agg(F.sum(debet - kredit).cast(NET_QTY).alias("net"))


def net_stock(by_unit: DataFrame, factor: Column, *keys: str) -> DataFrame:
    """Net stock per key of rows joined with their item."""
    return by_unit.groupBy(*keys).agg(F.round(F.sum(F.col("net") * factor), 4).alias("stok"))
