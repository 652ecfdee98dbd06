"""Changes since the last refresh, and a snapshot brought up to date with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.functions.numbers import NET_QTY
from stockledger.operators.items import ITEM, factor_of, item_factors
from stockledger.operators.movements import DELTA_POLICY, LedgerPolicy, movements
from stockledger.operators.stock import net_by_unit, net_stock
from stockledger.params import LedgerWindow
from stockledger.plans.snapshot import STOCK
from stockledger.sources.base import Source

DELTA = ["server_key", "kd_divisi", "kd_barang", "debet", "kredit", "kd_satuan", "source"]


def delta_movements(
    source: Source, window: LedgerWindow, policy: LedgerPolicy = DELTA_POLICY
) -> DataFrame:
    """Documents that reached the server after ``window.ingested_after``.

    A document counts however late it arrives, as long as its own date lies in the
    ledger window. Stock counts are not part of the feed.
    """
    if window.ingested_after is None:
        raise ValueError("a delta needs ingested_after")
    return movements(source, window, policy)


def delta_rows(
    source: Source, window: LedgerWindow, policy: LedgerPolicy = DELTA_POLICY
) -> DataFrame:
    return delta_movements(source, window, policy).withColumnRenamed("sumber", "source").select(*DELTA)


def delta_by_source(rows: DataFrame) -> DataFrame:
    """Rows and quantities of each kind of document in a delta."""
    return rows.groupBy("server_key", "source").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("debet").cast("double").alias("debet"),
        F.sum("kredit").cast("double").alias("kredit"),
    )


def accumulate(rows: DataFrame, source: Source) -> DataFrame:
    """Net change per division and item in smallest units."""
    return net_stock(
        net_by_unit(rows, *STOCK).join(item_factors(source), ITEM, "left"),
        factor_of(F.col("kd_satuan")),
        *STOCK,
    ).withColumnRenamed("stok", "delta_stok")


def apply_delta(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Snapshot with the changes added to its stock; nothing else changes.

    Keys the snapshot does not hold are left for the next full refresh, see
    ``unmatched``.
    """
    stok = F.round(F.col("stok_akhir").cast(NET_QTY) + F.col("delta_stok"), 4).cast("double")
    return snapshot.join(delta, STOCK, "left").select(
        *[
            F.coalesce(stok, "stok_akhir").alias(c) if c == "stok_akhir" else F.col(c)
            for c in snapshot.columns
        ]
    )


def unmatched(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Changed keys the snapshot does not hold."""
    return delta.join(snapshot.select(*STOCK), STOCK, "left_anti")


def matched(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    return delta.join(snapshot.select(*STOCK), STOCK, "left_semi")
