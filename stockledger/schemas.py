"""Column names and types of the operational tables and of the derived tables.

Every operational table carries ``server_key``: the site it belongs to. Single-site
sources get it as a constant, so one job serves one site or all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QTY = "decimal(18,4)"
PRICE = "decimal(18,2)"
RATE = "decimal(12,4)"

_SITE = {"server_key": "string"}
_DATES = {"tanggal": "timestamp_ntz", "tanggal_server": "timestamp_ntz"}
_DISCOUNTS = {f"diskon{i}": RATE for i in range(1, 5)}


def _dimension(key: str) -> dict[str, str]:
    return {**_SITE, key: "string", "nama": "string"}


def _header(key: str) -> dict[str, str]:
    return {**_SITE, key: "string", "kd_divisi": "string", **_DATES}


def _lines(key: str, price: str | None = None) -> dict[str, str]:
    columns = {
        **_SITE,
        key: "string",
        "line_no": "int",
        "kd_barang": "string",
        "qty": QTY,
        "kd_satuan": "string",
    }
    return {**columns, price: PRICE} if price else columns


TABLES: dict[str, dict[str, str]] = {
    "m_barang": {
        **_dimension("kd_barang"),
        "kd_kategori": "string",
        "kd_merk": "string",
        "kd_model": "string",
        "kd_warna": "string",
        "ukuran": "string",
    },
    "m_kategori": {**_dimension("kd_kategori"), "status": "int"},
    "m_merk": _dimension("kd_merk"),
    "m_model": _dimension("kd_model"),
    "m_warna": _dimension("kd_warna"),
    "m_satuan": _dimension("kd_satuan"),
    "m_divisi": {**_dimension("kd_divisi"), "keterangan": "string", "kepala_nota": "string"},
    "m_barang_satuan": {
        **_SITE,
        "kd_barang": "string",
        "kd_satuan": "string",
        "jumlah": QTY,
        "harga_jual": PRICE,
        "status": "int",
    },
    "m_barang_divisi": {
        **_SITE,
        "kd_divisi": "string",
        "kd_barang": "string",
        "stok_awal": QTY,
        "harga_beli_awal": PRICE,
    },
    "t_penjualan": _header("no_transaksi"),
    "t_penjualan_detail": _lines("no_transaksi", "harga_jual"),
    "t_pembelian": {
        **_header("no_transaksi"),
        "status": "int",
        **_DISCOUNTS,
        "pajak": RATE,
        "ppnbm": RATE,
    },
    "t_pembelian_detail": {**_lines("no_transaksi", "harga_beli"), **_DISCOUNTS},
    "t_mutasi_stok": {
        **_SITE,
        "no_transaksi": "string",
        "kd_divisi_asal": "string",
        "kd_divisi_tujuan": "string",
        **_DATES,
    },
    "t_mutasi_stok_detail": _lines("no_transaksi"),
    "t_penjualan_retur": _header("no_retur"),
    "t_penjualan_retur_detail": _lines("no_retur", "harga_jual"),
    "t_pembelian_retur": _header("no_retur"),
    "t_pembelian_retur_detail": _lines("no_retur", "harga"),
    "t_opname_stok": {
        **_SITE,
        "no_transaksi": "string",
        "kd_divisi": "string",
        "kd_barang": "string",
        "tanggal": "timestamp_ntz",
        "qty": QTY,
        "kd_satuan": "string",
        "status": "int",
    },
}

SNAPSHOT: dict[str, str] = {
    **_SITE,
    "kd_divisi": "string",
    "divisi": "string",
    "kd_barang": "string",
    "barang": "string",
    "kategori": "string",
    "merk": "string",
    "model": "string",
    "warna": "string",
    "ukuran": "string",
    "stok_akhir": "double",
    "harga_jual": "double",
    "harga_beli_akhir": "double",
    "harga_avg": "double",
}

# Columns that only break ties or only some sources keep; absent means null.
OPTIONAL = {"line_no", "tanggal_server"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def empty(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ddl(columns))


def conform(df: DataFrame, columns: dict[str, str], server_key: str | None = None) -> DataFrame:
    """Project ``df`` to the declared columns and types.

    A missing ``server_key`` becomes the given constant, a missing optional column
    null; any other missing column is an error of the source.
    """
    present = dict(df.dtypes)
    picked = []
    for name, kind in columns.items():
        if name in present:
            source = f"`{name}`" if present[name] == kind else f"cast(`{name}` AS {kind})"
        elif name == "server_key" and server_key is not None:
            source = "'" + server_key.replace("\\", "\\\\").replace("'", "\\'") + "'"
        elif name in OPTIONAL:
            source = f"cast(NULL AS {kind})"
        else:
            raise ValueError(f"source lacks column {name}; it has {sorted(present)}")
        picked.append(f"{source} AS `{name}`")
    return df.selectExpr(*picked)
