"""Movement histories with unit conversion, running balances and totals.

A history keeps its ledger rows apart from the attributes of items, divisions and units
that they need. Where totals are wanted, the ledger is first summed per (item, division,
day, kind, unit) and only these sums, its classes, meet the items, divisions and units.

For a running balance the rows are dealt by chunk, a group's rows of one division and
day: the only shuffle of rows. The classes are summed where the rows lie, described, and
come back as one row for each chunk, with what came before the chunk and the
descriptions of its few classes; a row takes the one of its class. So the ledger is read
once, a row meets one join, and an item, division or unit with a third of all movements
is spread over its chunks throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.functions import dates
from stockledger.functions.numbers import NET_QTY, RUNNING
from stockledger.functions.text import converted_label, or_blank
from stockledger.operators.items import ITEM, factor_of, in_active_category, item_cards
from stockledger.operators.movements import (
    HISTORY_POLICY,
    OPENING,
    SALE_RETURN,
    SALE_RETURN_WITH_RECEIPT,
    kind_label,
    movement_items,
    movements,
    needs_active_category,
)
from stockledger.operators.running import (
    COUNT,
    STRETCH,
    Level,
    bucket,
    busy_buckets,
    level_names,
    range_levels,
    running_totals,
    totals_before,
    whole_groups,
    with_levels,
    within_chunks,
)
from stockledger.operators.sharing import naming, unnamed
from stockledger.params import LedgerWindow
from stockledger.schemas import QTY
from stockledger.sources.base import Source

TIE_BREAKERS = ["branch_no", "no_transaksi", "line_no", "kd_satuan", "debet", "kredit", "harga"]
CLASS = ["kd_divisi", "branch_no", "kd_satuan"]
NOT_IN_CLASS = {"tanggal": "timestamp_ntz", "no_transaksi": "string", "line_no": "int", "harga": QTY}
# What a class has from its item, division and unit.
DESCRIBED = [
    "kd_divisi",
    "divisi",
    "kepala_nota",
    "transaksi",
    "barang",
    "kd_satuan",
    "satuan",
    "konversi",
]
COLUMNS = [
    "server_key",
    "kd_divisi",
    "divisi",
    "kepala_nota",
    "tanggal",
    "transaksi",
    "no_transaksi",
    "kd_barang",
    "barang",
    "debet",
    "kredit",
    "kd_satuan",
    "satuan",
    "harga",
    "konversi",
    "branch_no",
    "line_no",
]

# Whether the item of a row is one of those cut into chunks.
BUSY_ITEM = "ramai"

Step = Callable[[DataFrame], DataFrame]


def _lot(key: str) -> str:
    """Name of a level key on item cards, and on what is joined with them."""
    return key.replace("level", "lot")


@dataclass(frozen=True)
class History:
    """Ledger rows, the items they refer to, and the steps that make a history of both.

    ``describe`` gives carded rows their names and factors, all or none for the rows of
    a class; ``steps`` follow. A step sees one column set, whether the rows are single
    movements or their sums per class, and treats quantities linearly; so it may be
    applied to either. Columns that start with two underscores pass through.
    """

    ledger: DataFrame
    cards: DataFrame
    describe: tuple[Step, ...]
    steps: tuple[Step, ...] = ()
    # The item of each movement before any filter but that of the items; None: not to be counted apart.
    keys: DataFrame | None = None

    def then(self, step: Step) -> "History":
        return replace(self, steps=(*self.steps, step))

    def described(self, carded: DataFrame) -> DataFrame:
        for step in self.describe:
            carded = step(carded)
        return carded

    def shape(self, described: DataFrame) -> DataFrame:
        for step in self.steps:
            described = step(described)
        return described

    def rows(self) -> DataFrame:
        """All movements of the history, in no order."""
        return self.shape(self.described(self.ledger.join(self.cards, ITEM, "left")))

    def classes(self) -> DataFrame:
        """Summed quantities and row counts per item and class."""
        return self.shape(self._described_sums(self.ledger))

    def _described_sums(
        self, ledger: DataFrame, *keys: str, more: Sequence[Column] = (), cards: DataFrame | None = None, on: Sequence[str] = ()
    ) -> DataFrame:
        summed = ledger.groupBy(*ITEM, *CLASS, *keys).agg(
            F.sum("debet").alias("debet"),
            F.sum("kredit").alias("kredit"),
            F.count(F.lit(1)).alias(COUNT),
            *more,
        )
        if more:
            summed = unnamed(summed)
        own = F.struct(*[F.col(c).alias(f"own_{c}") for c in CLASS])
        blank = {c: F.lit(None).cast(kind) for c, kind in NOT_IN_CLASS.items()}
        summed = summed.withColumns({**blank, "__own": own})
        summed = summed.withColumnsRenamed({key: _lot(key) for key in on})
        carded = summed.join(self.cards if cards is None else cards, [*ITEM, *[_lot(key) for key in on]], "left")
        return self.described(carded.withColumnsRenamed({_lot(key): key for key in on}))

    def chunk_classes(
        self, dealt: DataFrame, *keys: str, cards: DataFrame | None = None, on: Sequence[str] = ()
    ) -> DataFrame:
        """Classes per item and ``keys`` of rows dealt by both; ``__class`` describes a class.

        The sums share the shuffle of the rows. ``cards`` may be item cards dealt like them, which carry
        those of the keys, ``on``, by the names of ``_lot``: then the sums stay where they are.
        """
        described = self._described_sums(dealt, *keys, more=[naming(*NOT_IN_CLASS, "debet", "kredit")], cards=cards, on=on)
        return self.shape(described.withColumn("__class", F.struct("__own.*", *DESCRIBED)))

    def chunk_rows(self, rows: DataFrame) -> DataFrame:
        """Movements of rows that carry the ``__classes`` of their chunk.

        A row takes the description of its class. An opening row for each base unit has several,
        and a row whose class has been left out has none.
        """
        mine = F.filter(
            "__classes",
            lambda c: (c["own_branch_no"] == F.col("branch_no"))
            & c["own_kd_divisi"].eqNullSafe(F.col("kd_divisi"))
            & c["own_kd_satuan"].eqNullSafe(F.col("kd_satuan")),
        )
        return self.class_rows(rows.withColumn("__class", F.explode(mine)).drop("__classes"))

    def class_rows(self, each: DataFrame) -> DataFrame:
        """Movements of rows that carry the ``__class`` they are described by."""
        hidden = [c for c in each.columns if c.startswith("__") and c != "__class"]
        values = {c: F.coalesce(c, F.lit(0)) for c in ("debet", "kredit", "harga")}
        values |= {c: F.col(f"__class.{c}") for c in DESCRIBED}
        return self.shape(each.select(*[values.get(c, F.col(c)).alias(c) for c in COLUMNS], *hidden))


def movement_history(
    source: Source,
    closing_ts,
    items: Iterable[str] | None = None,
    divisions: Iterable[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    known_only: bool = False,
    opening_units: str = "first",
) -> History:
    """Every movement after the closing, for some items or all of them.

    start, end      days to keep; an opening row is dated at the closing and drops out of
                    a range that starts later, so balances over a range start at 0
    known_only      drop rows of unknown divisions or items, and use the short label of
                    sale returns; otherwise such names are blank
    opening_units   "first": opening rows take the item's first base unit; "each": one
                    opening row per base unit, none for an item without a base unit
    """
    if opening_units not in ("first", "each"):
        raise ValueError(f"opening_units is 'first' or 'each', not {opening_units!r}")
    items = None if items is None else list(items)
    ledger = movements(source, LedgerWindow(closing_ts), HISTORY_POLICY, items, divisions)
    wanted = dates.day_range(F.col("tanggal"), start, end)
    if wanted is not None:
        ledger = ledger.where(wanted)
    ledger = ledger.where("kd_barang is not null").drop("tanggal_server", "sumber")

    divisi = source.table("m_divisi").select("server_key", "kd_divisi", "keterangan", "kepala_nota")
    satuan = source.table("m_satuan").select("server_key", "kd_satuan", F.col("nama").alias("satuan"))

    def counted(rows: DataFrame) -> DataFrame:
        if known_only:
            rows = rows.where("known")
        return in_active_category(rows, needs_active_category())

    def with_unit_code(rows: DataFrame) -> DataFrame:
        opens = F.col("branch_no") == OPENING.no
        if opening_units == "each":
            base = F.map_keys(F.map_filter("factors", lambda _, jumlah: jumlah == 1))
            each = F.when(opens, F.coalesce(base, F.array()))
            rows = rows.withColumn("base_unit", F.explode_outer(each))
            rows = rows.where(~opens | F.col("base_unit").isNotNull())
        code = F.when(opens, F.col("base_unit")).otherwise(F.col("kd_satuan"))
        return rows.withColumn("kd_satuan", code)

    def with_names(rows: DataFrame) -> DataFrame:
        label = kind_label()
        if not known_only:
            label = F.when(
                F.col("branch_no") == SALE_RETURN.no, SALE_RETURN_WITH_RECEIPT
            ).otherwise(label)
        hidden = [c for c in rows.columns if c.startswith("__")]
        return (
            rows.join(divisi, ["server_key", "kd_divisi"], "inner" if known_only else "left")
            .join(satuan, ["server_key", "kd_satuan"], "left")
            .withColumns(
                {
                    "kd_divisi": or_blank(F.col("kd_divisi")),
                    "divisi": or_blank(F.col("keterangan")),
                    "kepala_nota": or_blank(F.col("kepala_nota")),
                    "transaksi": label,
                    "barang": or_blank(F.col("barang")),
                    "debet": F.coalesce("debet", F.lit(0)),
                    "kredit": F.coalesce("kredit", F.lit(0)),
                    "satuan": or_blank(F.col("satuan")),
                    "harga": F.coalesce("harga", F.lit(0)),
                    "konversi": factor_of(F.col("kd_satuan")),
                }
            )
            .select(*COLUMNS, *hidden)
        )

    keys = movement_items(source, items)
    return History(ledger, item_cards(source), (counted, with_unit_code, with_names), keys=keys)


def with_unit(history: History, satuan: str = "ALL") -> History:
    """Only the rows of one unit name; ``ALL`` keeps every row."""
    if satuan == "ALL":
        return history
    return history.then(lambda rows: rows.where(F.col("satuan") == satuan))


def converted(history: History) -> History:
    """Quantities in smallest units; the unit name says where that changed them."""
    changed = {
        "debet": F.col("debet").cast(NET_QTY) * F.col("konversi"),
        "kredit": F.col("kredit").cast(NET_QTY) * F.col("konversi"),
        "satuan": converted_label(F.col("satuan"), F.col("konversi")),
    }
    return history.then(lambda rows: rows.withColumns(changed))


def _day() -> Column:
    return F.coalesce(F.to_date("tanggal"), F.lit("0001-01-01").cast("date"))


def _or_epoch() -> Column:
    return F.coalesce("tanggal", dates.moment("1970-01-01"))


def _ledger_order() -> tuple[list[Level], list[Column]]:
    """Division, then date; documents of one date in the order of their kind."""
    return [Level(or_blank(F.col("kd_divisi"))), Level(_day(), kind="date", blank="0001-01-01")], [
        F.col(c).asc_nulls_first() for c in ("tanggal", *TIE_BREAKERS)
    ]


def _screen_order(ascending: bool = True) -> tuple[list[Level], list[Column]]:
    """Date over all divisions, a missing date counting as the epoch."""
    moment = _or_epoch()
    levels = [
        Level(F.to_date(moment), ascending, "date", "0001-01-01"),
        Level(moment, ascending, "timestamp_ntz", "0001-01-01"),
        Level(or_blank(F.col("kd_divisi"))),
    ]
    return levels, [F.col(c).asc_nulls_first() for c in ("tanggal", *TIE_BREAKERS)]


def _net() -> Column:
    return (F.col("debet") - F.col("kredit")).cast(RUNNING)


def _balanced(
    history: History, levels: list[Level], order: list[Column], reset_per_division: bool
) -> DataFrame:
    ledger = history.ledger.drop("transaksi")
    found = None if history.keys is None else busy_buckets(history.keys, ITEM)
    # An item that is not busy is one chunk. No bucket has the number -1.
    busy = F.lit(True) if found is None else bucket(ITEM).isin(*(found or [-1]))
    cut = [Level(F.when(busy, v.key).otherwise(F.lit(v.blank).cast(v.kind)), v.ascending) for v in levels]
    within = [v.key.asc() if v.ascending else v.key.desc() for v in levels] + order
    ledger, names, division = with_levels(ledger, cut), level_names(levels), or_blank(F.col("kd_divisi"))
    group = [*ITEM, "__division"] if reset_per_division else list(ITEM)
    chunk = [*group, *names]
    if found is not None and not found:
        lie = [*ITEM, *names]
        dealt = ledger.where(F.col("server_key").isNotNull()).repartition(*lie)
        blank = {_lot(n): F.when(busy, F.lit(None)).otherwise(F.lit(v.blank).cast(v.kind)) for n, v in zip(names, levels)}
        classes = history.chunk_classes(dealt, *names, cards=history.cards.withColumns(blank), on=names)
        # Neither side moves: the classes lie where the rows do. As bounds, which take a null as a value, since
        # an equality would have both sides dealt again by the class.
        mine, own = F.struct(*CLASS), F.struct(*[F.col(f"__class.own_{c}") for c in CLASS])
        same = [mine.alias("__mine"), own.alias("__own")]
        left, right = dealt.select("*", same[0]), classes.select(*lie, "__class", same[1])
        alike = [left[c] == right[c] for c in lie] + [left["__mine"] <= right["__own"], left["__mine"] >= right["__own"]]
        met = left.join(right, reduce(lambda a, b: a & b, alike)).select(left["*"], right["__class"]).drop("__mine")
        rows = history.class_rows(met.withColumn("__division", division))
        return whole_groups(rows, chunk, within, {"saldo": _net()}, ordinal="no").withColumn(BUSY_ITEM, F.lit(False))
    if reset_per_division:
        ledger = ledger.withColumn("__division", division)
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in chunk])
    dealt = ledger.where(present).repartition(*chunk)
    chunks = (
        history.chunk_classes(dealt, *[c for c in chunk if c not in ITEM])
        .groupBy(*chunk)
        .agg(
            F.sum(_net()).cast(RUNNING).alias("__sum0"),
            F.sum(COUNT).alias(COUNT),
            F.collect_list("__class").alias("__classes"),
        )
    )
    before = totals_before(chunks, group, cut, ["__sum0", COUNT], ["__classes"])
    rows = history.chunk_rows(dealt.join(before, chunk))
    return within_chunks(rows, chunk, within, {"saldo": _net()}, ordinal="no").withColumn(BUSY_ITEM, busy)


def with_balance(history: History, reset_per_division: bool = False) -> DataFrame:
    """Row number and running balance in ledger order.

    The balance of an item runs on over its divisions unless it is reset per division.
    """
    return _balanced(history, *_ledger_order(), reset_per_division)


def with_balance_by_date(
    history: History, ascending: bool = True, reset_per_division: bool = False
) -> DataFrame:
    """Row number and running balance by date, as a screen shows them."""
    return _balanced(history, *_screen_order(ascending), reset_per_division)


def numbered(history: History) -> DataFrame:
    """Row number of each movement of an item in ledger order."""
    return with_balance(history).drop("saldo")


def sort_order(column: str, ascending: bool = True) -> list[Column]:
    """Any history column, nulls last either way; rows of one value keep ledger order.

    A missing date counts as the epoch. Sorting by the balance leaves ledger order.
    """
    if column == "saldo":
        return [F.col("no").asc()]
    value = _or_epoch() if column == "tanggal" else F.col(column)
    key = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return [key, F.col("no").asc()]


def sorted_history(
    history: DataFrame, column: str, ascending: bool = True, name: str = "urutan"
) -> DataFrame:
    """Position of each movement of an item, and its balance, in the chosen order.

    ``history`` are rows of ``numbered``, with the row number ``no``. A column of any kind can be
    chosen, so the chunks of busy items are ranges of its values instead of the leading keys of the ledger
    order; the bounds are asked of their rows when the order is declared. Other items are one chunk each.
    """
    order, sums = sort_order(column, ascending), {"saldo": _net()}

    def cut(rows: DataFrame) -> DataFrame:
        if column == "saldo":
            levels = [Level(F.floor(F.col("no") / STRETCH))]
        else:
            value = _or_epoch() if column == "tanggal" else F.col(column)
            levels = range_levels(rows, value, ascending, F.col("no"))
        return running_totals(rows, ITEM, levels, order, sums, name)

    if BUSY_ITEM not in history.columns:
        return cut(history)
    # Which items are busy depends on the item only, so the condition reaches the scans.
    busy, calm = history.where(BUSY_ITEM), history.where(~F.col(BUSY_ITEM))
    found = whole_groups(calm, ITEM, order, sums, name)
    return found if busy.isEmpty() else found.unionByName(cut(busy))


def totals(history: History) -> DataFrame:
    """Quantities in and out and the closing balance of each item."""
    return (
        history.classes()
        .groupBy(*ITEM)
        .agg(F.sum("debet").alias("debet"), F.sum("kredit").alias("kredit"))
        .select(
            *ITEM,
            F.col("debet").cast("double").alias("total_debet"),
            F.col("kredit").cast("double").alias("total_kredit"),
            (F.col("debet") - F.col("kredit")).cast("double").alias("saldo_akhir"),
        )
    )


def unit_names(history: History) -> DataFrame:
    """Unit names that occur in the history of each item."""
    return history.classes().where(F.col("satuan") != "").select(*ITEM, "satuan").distinct()


def in_history_order(
    history: DataFrame, column: str | None = None, ascending: bool = True
) -> DataFrame:
    """Rows sorted for output: per item in ledger order, or by a column."""
    if column is None:
        return history.orderBy(*ITEM, "no")
    return history.orderBy(*ITEM, *sort_order(column, ascending))


def display(history: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """History columns as text and doubles, with the date in full."""
    quantity = ("debet", "kredit", "harga", "konversi", "saldo")
    names = [
        "server_key",
        "kd_divisi",
        "divisi",
        "kepala_nota",
        "tanggal",
        "transaksi",
        "no_transaksi",
        "kd_barang",
        "barang",
        "debet",
        "kredit",
        "kd_satuan",
        "satuan",
        "harga",
        "konversi",
        *extra,
    ]
    shown = []
    for name in names:
        column = F.col(name)
        if name == "tanggal":
            column = dates.as_text(column)
        elif name in quantity:
            column = F.round(column, 4).cast("double")
        shown.append(column.alias(name))
    return history.select(*shown)
