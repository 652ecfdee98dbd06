"""The ledger: every kind of document as rows of quantity in and quantity out.

One movement row is (server_key, kd_divisi, kd_barang, tanggal, tanggal_server,
branch_no, transaksi, sumber, no_transaksi, line_no, kd_satuan, debet, kredit, harga).
All products read this one relation; columns a product does not use are pruned down
to the scans, and its date, item and division filters are pushed into every branch.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions import dates
from stockledger.params import LedgerWindow
from stockledger.schemas import PRICE, QTY
from stockledger.sources.base import Source
from stockledger.streaming.documents import joined_streams


@dataclass(frozen=True)
class Branch:
    no: int
    label: str
    table: str
    source: str | None
    inbound: bool


# Order, names, tables and tags of the nine kinds of movement.
OPENING = Branch(1, "Stok Awal", "m_barang_divisi", None, True)
TRANSFER_OUT = Branch(2, "Mutasi Keluar", "t_mutasi_stok", "mutasi_out", False)
TRANSFER_IN = Branch(3, "Mutasi Masuk", "t_mutasi_stok", "mutasi_in", True)
COUNT_IN = Branch(4, "Opname Masuk", "t_opname_stok", None, True)
COUNT_OUT = Branch(5, "Opname Keluar", "t_opname_stok", None, False)
PURCHASE = Branch(6, "Pembelian", "t_pembelian", "pembelian", True)
PURCHASE_RETURN = Branch(7, "Retur Pembelian", "t_pembelian_retur", "retur_beli", False)
SALE = Branch(8, "Penjualan", "t_penjualan", "penjualan", False)
SALE_RETURN = Branch(9, "Retur Penjualan", "t_penjualan_retur", "retur_jual", True)
SALE_RETURN_WITH_RECEIPT = "Retur Penjualan Dengan Nota"

ALL = (
    OPENING,
    TRANSFER_OUT,
    TRANSFER_IN,
    COUNT_IN,
    COUNT_OUT,
    PURCHASE,
    PURCHASE_RETURN,
    SALE,
    SALE_RETURN,
)
# Branches whose rows count only while the item's category is active.
NEED_ACTIVE_CATEGORY = (OPENING, SALE)


# Columns a document gives to its movement rows.
DOCUMENT = (
    "server_key",
    "kd_divisi",
    "kd_barang",
    "tanggal",
    "tanggal_server",
    "no_transaksi",
    "line_no",
    "kd_satuan",
)


@dataclass(frozen=True)
class LedgerPolicy:
    """Which branches a product reads, and which purchase statuses count (None: all)."""

    branches: tuple[Branch, ...]
    purchase_status: tuple[int, ...] | None = None

    def wants(self, *branches: Branch) -> bool:
        return any(b in self.branches for b in branches)

    def only(self, *branches: Branch) -> "LedgerPolicy":
        return LedgerPolicy(branches, self.purchase_status)


SNAPSHOT_POLICY = LedgerPolicy(tuple(b for b in ALL if b is not COUNT_OUT))
HISTORY_POLICY = LedgerPolicy(ALL, purchase_status=(0, 1))
DELTA_POLICY = LedgerPolicy(tuple(b for b in ALL if b.source is not None))


ZERO = f"cast(0 AS {QTY})"


def _text(value: str | None) -> str:
    return "cast(NULL AS string)" if value is None else f"'{value}'"


def _side(branch: Branch, qty: str) -> dict[str, str]:
    """What a branch adds to a document row: its tags, and the quantity on one side."""
    return {
        "branch_no": str(branch.no),
        "transaksi": _text(branch.label),
        "sumber": _text(branch.source),
        "debet": qty if branch.inbound else ZERO,
        "kredit": ZERO if branch.inbound else qty,
    }


def _rows(df: DataFrame, harga: str, side: dict[str, str], **columns: str) -> DataFrame:
    """Movement rows; ``columns`` says where a column of another name or value comes from."""
    named = {c: columns.get(c, c) for c in DOCUMENT} | {"harga": f"cast({harga} AS {PRICE})"}
    return df.selectExpr(*[f"{value} AS {name}" for name, value in (named | side).items()])


def document_lines(
    source: Source, name: str, key: str, window: LedgerWindow | None = None, *header: str
) -> DataFrame:
    """Lines of ``<name>_detail`` with the date and the named columns of their header.

    The header is cut to the window before the join, so the date bounds reach its scan. Where
    both are streams, either may come first.
    """
    heads = source.table(name)
    if window is not None:
        heads = heads.where(dates.in_window(F.col("tanggal"), window))
        ingested = dates.ingest_bounds(F.col("tanggal_server"), window)
        if ingested is not None:
            heads = heads.where(ingested)
    heads = heads.select("server_key", key, "tanggal", "tanggal_server", *header)
    lines = source.table(f"{name}_detail")
    if lines.isStreaming and heads.isStreaming:
        return joined_streams(lines, heads, ["server_key", key], source.wait, source.carried)
    return lines.join(heads, ["server_key", key])


def opening(source: Source, window: LedgerWindow) -> DataFrame:
    """Opening stock, dated at the closing moment.

    The unit is left null: opening stock is kept in smallest units, so its factor is 1
    with or without a base unit. Histories put the unit's code in.
    """
    closing = dates.moment(window.closing_ts)
    return _rows(
        source.table(OPENING.table).withColumn("tanggal", closing),
        "harga_beli_awal",
        _side(OPENING, "stok_awal"),
        tanggal_server="cast(NULL AS timestamp_ntz)",
        no_transaksi="'0'",
        line_no="cast(NULL AS int)",
        kd_satuan="cast(NULL AS string)",
    )


def transfers(source: Source, window: LedgerWindow, policy: LedgerPolicy) -> DataFrame:
    """Both sides of each transfer line from one scan and one join."""
    lines = document_lines(
        source, TRANSFER_OUT.table, "no_transaksi", window, "kd_divisi_asal", "kd_divisi_tujuan"
    )
    sides = []
    for branch, division in (
        (TRANSFER_OUT, "kd_divisi_asal"),
        (TRANSFER_IN, "kd_divisi_tujuan"),
    ):
        if policy.wants(branch):
            row = {"kd_divisi": division, **_side(branch, "qty")}
            fields = ", ".join(f"'{name}', {value}" for name, value in row.items())
            sides.append(f"named_struct({fields})")
    both = lines.selectExpr(
        *[c for c in DOCUMENT if c != "kd_divisi"], f"inline(array({', '.join(sides)}))"
    )
    return _rows(both, "0", {c: c for c in _side(TRANSFER_IN, "qty")})


def counts(source: Source, window: LedgerWindow, policy: LedgerPolicy) -> DataFrame:
    """Stock counts: status 2 adds, any other status takes out; a null status is neither."""
    rows = source.table(COUNT_IN.table).where(dates.in_window(F.col("tanggal"), window))
    adds = F.col("status") == 2
    if not policy.wants(COUNT_OUT):
        rows = rows.where(adds)
    elif not policy.wants(COUNT_IN):
        rows = rows.where(~adds)
    else:
        rows = rows.where(F.col("status").isNotNull())
    inward, outward = _side(COUNT_IN, "qty"), _side(COUNT_OUT, "qty")
    either = {
        name: f"CASE WHEN status = 2 THEN {inward[name]} ELSE {outward[name]} END"
        for name in inward
    }
    return _rows(
        rows, "0", either, tanggal_server="cast(NULL AS timestamp_ntz)", line_no="cast(NULL AS int)"
    )


def purchases(source: Source, window: LedgerWindow, policy: LedgerPolicy) -> DataFrame:
    lines = document_lines(
        source, PURCHASE.table, "no_transaksi", window, "kd_divisi", "status"
    )
    if policy.purchase_status is not None:
        lines = lines.where(F.col("status").isin(*policy.purchase_status))
    return _rows(lines, "harga_beli", _side(PURCHASE, "qty"))


def _plain(
    source: Source, window: LedgerWindow, branch: Branch, key: str, price: str
) -> DataFrame:
    lines = document_lines(source, branch.table, key, window, "kd_divisi")
    return _rows(lines, price, _side(branch, "qty"), no_transaksi=key)


def movements(
    source: Source,
    window: LedgerWindow,
    policy: LedgerPolicy,
    items: Iterable[str] | None = None,
    divisions: Iterable[str] | None = None,
) -> DataFrame:
    """The branches of ``policy`` as one relation, each document table read once."""
    parts = []
    if policy.wants(OPENING):
        parts.append(opening(source, window))
    if policy.wants(TRANSFER_OUT, TRANSFER_IN):
        parts.append(transfers(source, window, policy))
    # Counts carry no ingest time, so a change feed cannot contain them.
    if policy.wants(COUNT_IN, COUNT_OUT) and window.ingested_after is None:
        parts.append(counts(source, window, policy))
    if policy.wants(PURCHASE):
        parts.append(purchases(source, window, policy))
    if policy.wants(PURCHASE_RETURN):
        parts.append(_plain(source, window, PURCHASE_RETURN, "no_retur", "harga"))
    if policy.wants(SALE):
        parts.append(_plain(source, window, SALE, "no_transaksi", "harga_jual"))
    if policy.wants(SALE_RETURN):
        parts.append(_plain(source, window, SALE_RETURN, "no_retur", "harga_jual"))
    ledger = reduce(DataFrame.unionByName, parts)
    if items is not None:
        ledger = ledger.where(F.col("kd_barang").isin(*items))
    if divisions is not None:
        ledger = ledger.where(F.col("kd_divisi").isin(*divisions))
    return ledger


def movement_items(source: Source, items: Iterable[str] | None = None) -> DataFrame:
    """The item of every movement there may be, from the tables of lines alone: no header, no window."""
    tables = [OPENING.table, COUNT_IN.table, *[f"{b.table}_detail" for b in ALL if b.source is not None]]
    rows = [source.table(name).select("server_key", "kd_barang") for name in dict.fromkeys(tables)]
    # Each line of a transfer moves twice.
    moved = source.table(f"{TRANSFER_OUT.table}_detail").select("server_key", "kd_barang")
    found = reduce(DataFrame.unionByName, [*rows, moved]).where("kd_barang is not null")
    return found if items is None else found.where(F.col("kd_barang").isin(*items))


def kind_label() -> Column:
    """Label of a movement from the number of its branch."""
    return F.coalesce(*[F.when(F.col("branch_no") == b.no, F.lit(b.label)) for b in ALL])


def needs_active_category() -> Column:
    return F.col("branch_no").isin(*[b.no for b in NEED_ACTIVE_CATEGORY])
