"""One row per item: units, master attributes, division and price lookups.

Everything a movement needs from its item is brought into one item table keyed by
(server_key, kd_barang). The parts share that key, so building the table needs one
shuffle per source table, and a ledger joins it once instead of once per dimension.
Whether a join is broadcast is left to the measured size of the side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions.numbers import ZERO_IS_ONE, unit_factor
from stockledger.schemas import QTY
from stockledger.sources.base import Source

ITEM = ["server_key", "kd_barang"]


def _unit_sums() -> list[Column]:
    """Base unit and all units of a group of unit rows; a row without a unit adds nothing."""
    row = F.when(F.col("kd_satuan").isNotNull(), F.struct("kd_satuan", "jumlah"))
    return [
        F.min(F.when(F.col("jumlah") == 1, F.col("kd_satuan"))).alias("base_unit"),
        F.sort_array(F.collect_list(row)).alias("units"),
    ]


def _factors() -> Column:
    """Factor per unit; the last of several rows of a unit is its largest factor."""
    last_of_unit = F.filter(
        "units",
        lambda unit, i: ~unit["kd_satuan"].eqNullSafe(F.get("units", i + 1)["kd_satuan"]),
    )
    return F.map_from_entries(last_of_unit).alias("factors")


def item_units(source: Source) -> DataFrame:
    """Per item: base unit, base unit on sale with its price, and the factor of each unit.

    Where an item has several base units the first code in order is kept. Where a unit
    is registered twice the larger factor counts.
    """
    on_sale = (F.col("jumlah") == 1) & (F.col("status") != 0)
    sale_unit = F.min(F.when(on_sale, F.struct("kd_satuan", "harga_jual"))).alias("sale_unit")
    per_item = source.table("m_barang_satuan").groupBy(*ITEM).agg(sale_unit, *_unit_sums())
    return per_item.select(*ITEM, "base_unit", "sale_unit", _factors())


def item_factors(source: Source) -> DataFrame:
    return item_units(source).select(*ITEM, "factors")


def factor_of(kd_satuan: Column, zero: str = ZERO_IS_ONE) -> Column:
    """Conversion factor of a unit, from the ``factors`` of a joined item."""
    return unit_factor(F.col("factors")[kd_satuan], zero)


def item_master(source: Source) -> DataFrame:
    """Active items with all their names; an item lacking any dimension is left out."""
    units = item_units(source).where("sale_unit is not null").select(*ITEM, "sale_unit")
    active = source.table("m_kategori").where("status <> 2")

    def named(table: str, key: str, name: str) -> DataFrame:
        return source.table(table).select("server_key", key, F.col("nama").alias(name))

    return (
        source.table("m_barang")
        .join(
            active.select("server_key", "kd_kategori", F.col("nama").alias("kategori")),
            ["server_key", "kd_kategori"],
        )
        .join(named("m_merk", "kd_merk", "merk"), ["server_key", "kd_merk"])
        .join(named("m_model", "kd_model", "model"), ["server_key", "kd_model"])
        .join(named("m_warna", "kd_warna", "warna"), ["server_key", "kd_warna"])
        .join(units, ITEM)
        .select(
            *ITEM,
            "nama",
            "kd_kategori",
            "kd_merk",
            "kd_model",
            "kd_warna",
            "ukuran",
            "kategori",
            "merk",
            "model",
            "warna",
            F.col("sale_unit.harga_jual").alias("harga_jual"),
            F.col("sale_unit.kd_satuan").alias("kd_satuan_terkecil"),
        )
    )


def item_cards(source: Source) -> DataFrame:
    """Every item with its name, category status and units, active or not.

    A unit may be registered for a code the item table lacks; its factor still counts.
    Items and units are brought together by grouping their union rather than by a full
    join: one shuffle, and a filter on the item reaches both scans.
    """
    kategori = source.table("m_kategori").selectExpr(
        "server_key", "kd_kategori", "status AS kategori_status"
    )
    items = source.table("m_barang").join(kategori, ["server_key", "kd_kategori"], "left")
    parts = items.selectExpr(
        *ITEM,
        "true AS known",
        "nama AS barang",
        "kategori_status",
        "cast(NULL AS string) AS kd_satuan",
        f"cast(NULL AS {QTY}) AS jumlah",
    ).unionByName(
        source.table("m_barang_satuan").selectExpr(
            *ITEM,
            "false AS known",
            "cast(NULL AS string) AS barang",
            "cast(NULL AS int) AS kategori_status",
            "kd_satuan",
            "jumlah",
        )
    )
    merged = parts.groupBy(*ITEM).agg(
        *[F.max(c).alias(c) for c in ("known", "barang", "kategori_status")], *_unit_sums()
    )
    return merged.select(*ITEM, "known", "barang", "kategori_status", "base_unit", _factors())


def in_active_category(ledger: DataFrame, flag: Column) -> DataFrame:
    """Drop flagged rows unless their item's category is known and not switched off."""
    return ledger.where(~flag | F.coalesce(F.col("kategori_status") != 2, F.lit(False)))


def division_names(source: Source) -> DataFrame:
    return source.table("m_divisi").select("server_key", "kd_divisi", F.col("nama").alias("divisi"))
