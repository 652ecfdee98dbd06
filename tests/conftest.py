from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from stockledger import schemas
from stockledger.session import build_session
from stockledger.sources import FrameSource

CLOSING = "2024-01-31 12:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = build_session(
        "stockledger-tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "2",
            "spark.default.parallelism": "1",
            "spark.sql.adaptive.enabled": "false",
            # Tiny frames: compiling each stage would take longer than running it.
            "spark.sql.codegen.wholeStage": "false",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "4000",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(root / "checkpoint"),
            "spark.sql.warehouse.dir": str(root / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(kind: str, value):
    if value is None:
        return None
    if kind.startswith("decimal"):
        return Decimal(str(value))
    if kind == "timestamp_ntz":
        return datetime.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def tables(spark):
    """Make a source from literal rows; columns not given are null, tables not given empty."""

    def make(server_key: str | None = "main", **rows: list[dict]) -> FrameSource:
        frames = {}
        rows.setdefault("m_barang", [])
        for name, items in rows.items():
            columns = dict(schemas.TABLES[name])
            if server_key is not None:
                columns.pop("server_key")
            data = [tuple(_value(k, item.get(c)) for c, k in columns.items()) for item in items]
            frames[name] = spark.createDataFrame(data, schemas.ddl(columns))
        return FrameSource(spark, frames, server_key, on_missing="empty")

    return make


def item(kode: str, **changes) -> dict:
    base = {
        "kd_barang": kode,
        "nama": f"Item {kode}",
        "kd_kategori": "K",
        "kd_merk": "M",
        "kd_model": "O",
        "kd_warna": "W",
        "ukuran": "L",
    }
    return {**base, **changes}


def unit(kode: str, satuan: str, jumlah, harga=10, status=1) -> dict:
    return {
        "kd_barang": kode,
        "kd_satuan": satuan,
        "jumlah": jumlah,
        "harga_jual": harga,
        "status": status,
    }


def dimensions() -> dict[str, list[dict]]:
    return {
        "m_kategori": [
            {"kd_kategori": "K", "nama": "active", "status": 1},
            {"kd_kategori": "X", "nama": "off", "status": 2},
        ],
        "m_merk": [{"kd_merk": "M", "nama": "brand"}],
        "m_model": [{"kd_model": "O", "nama": "model"}],
        "m_warna": [{"kd_warna": "W", "nama": "colour"}],
        "m_satuan": [{"kd_satuan": "PCS", "nama": "Pieces"}, {"kd_satuan": "BOX", "nama": "Box"}],
        "m_divisi": [
            {"kd_divisi": d, "nama": f"Div {d}", "keterangan": f"Division {d}", "kepala_nota": d}
            for d in ("A", "B")
        ],
    }


def sale(no: str, divisi: str, kode: str, qty, satuan="PCS", tanggal="2024-02-10 08:00:00",
         server="2024-02-10 09:00:00", harga=10, line=1) -> tuple[dict, dict]:
    return (
        {"no_transaksi": no, "kd_divisi": divisi, "tanggal": tanggal, "tanggal_server": server},
        {"no_transaksi": no, "line_no": line, "kd_barang": kode, "qty": qty, "kd_satuan": satuan,
         "harga_jual": harga},
    )


def purchase(no: str, divisi: str, kode: str, qty, satuan="PCS", tanggal="2024-02-05 08:00:00",
             server="2024-02-05 09:00:00", harga=8, status=1, line=1, **extra) -> tuple[dict, dict]:
    header = {"no_transaksi": no, "kd_divisi": divisi, "tanggal": tanggal,
              "tanggal_server": server, "status": status}
    header |= {k[2:]: v for k, v in extra.items() if k.startswith("h_")}
    line_row = {"no_transaksi": no, "line_no": line, "kd_barang": kode, "qty": qty,
                "kd_satuan": satuan, "harga_beli": harga}
    line_row |= {k: v for k, v in extra.items() if not k.startswith("h_")}
    return header, line_row


def split(name: str, documents: list[tuple[dict, dict]]) -> dict[str, list[dict]]:
    return {name: [d[0] for d in documents], f"{name}_detail": [d[1] for d in documents]}


def rows(df, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(map(str, r)))
