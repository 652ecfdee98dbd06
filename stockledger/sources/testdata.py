"""Operational tables derived from the star-schema test tables.

Each table is a lazy projection of the given parquet files, so the work of every
query grows with them. The rules are those of FIXTURES.md, part 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.schemas import PRICE, QTY, ddl
from stockledger.sources.base import Source

# Fixed values of the mapping.
UNIT_NAMES = (("PCS", "Pieces"), ("BOX", "Box"), ("NOL", "Nol"), ("NUL", "Nul"), ("BJI", "Biji"))

# Columns of the test tables that the mapping uses.
RAW = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_nationkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_nationkey": "int"},
    "part": {
        "p_partkey": "bigint",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint",
        "ts": "timestamp_ntz",
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
    },
}

SALES = "l_returnflag = 'N'"
PURCHASES = "l_returnflag = 'A' AND l_linestatus = 'F'"
TRANSFERS = "l_returnflag = 'A' AND l_linestatus = 'O'"
SALE_RETURNS = "l_returnflag = 'R' AND l_linestatus = 'F'"
PURCHASE_RETURNS = "l_returnflag = 'R' AND l_linestatus = 'O'"

ORDER_KEY = "cast(l_orderkey AS string)"
PAIR_KEY = "concat(cast(l_orderkey AS string), '-', cast(l_suppkey AS string))"
UNIT_OF_LINE = (
    "CASE WHEN l_linenumber <= 2 THEN 'PCS' WHEN l_linenumber = 3 THEN 'BOX' "
    "WHEN l_linenumber = 4 THEN 'KRT' WHEN l_linenumber = 5 THEN 'NUL' "
    "WHEN l_linenumber = 6 THEN 'NOL' END AS kd_satuan"
)
LINE_PRICE = f"cast(l_extendedprice AS {PRICE}) AS "


class TestdataSource(Source):
    """``by_region=True`` makes each region of the divisions a site of its own.

    ``lineitem`` replaces the line table, for instance by a stream of it; document
    headers are always read from the files.
    """

    __test__ = False

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        by_region: bool = False,
        lineitem: DataFrame | None = None,
    ):
        super().__init__(spark, None if by_region else "main")
        self.sf_dir = sf_dir
        self.by_region = by_region
        self._files: dict[str, DataFrame] = {}
        self.lineitem = self._raw("lineitem") if lineitem is None else lineitem

    def _raw(self, name: str) -> DataFrame:
        if name not in self._files:
            reader = self.spark.read.schema(ddl(RAW[name]))
            self._files[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._files[name]

    def exists(self, name: str) -> bool:
        return hasattr(self, f"_{name}")

    def _read(self, name: str) -> DataFrame:
        return getattr(self, f"_{name}")()

    def _restrict(self, df: DataFrame) -> DataFrame:
        return df

    # ---- sites -------------------------------------------------------------

    def _on_every_site(self, df: DataFrame) -> DataFrame:
        if not self.by_region:
            return df
        # One value, the list of sites: a subquery that depends on no row, so nothing is joined.
        sites = self._raw("region").agg(F.array_sort(F.collect_set(F.col("r_regionkey").cast("string")))).scalar()
        return df.withColumn("server_key", F.explode(sites))

    def _nation(self) -> DataFrame:
        site = "cast(n_regionkey AS string)" if self.by_region else f"'{self.server_key}'"
        return self._raw("nation").selectExpr("*", f"{site} AS server_key")

    # ---- item master -------------------------------------------------------

    def _m_barang(self) -> DataFrame:
        return self._on_every_site(
            self._raw("part").selectExpr(
                "cast(p_partkey AS string) AS kd_barang",
                "p_name AS nama",
                "p_type AS kd_kategori",
                "p_brand AS kd_merk",
                "split_part(p_name, ' ', 2) AS kd_model",
                "split_part(p_name, ' ', 1) AS kd_warna",
                "cast(p_size AS string) AS ukuran",
            )
        )

    def _names(self, key: str, value: str, *columns: str) -> DataFrame:
        names = self._raw("part").selectExpr(f"{value} AS {key}").distinct()
        return self._on_every_site(names.selectExpr(key, *(columns or (f"{key} AS nama",))))

    def _m_kategori(self) -> DataFrame:
        status = "CASE WHEN kd_kategori = 'PROMO' THEN 2 ELSE 1 END AS status"
        return self._names("kd_kategori", "p_type", "lower(kd_kategori) AS nama", status)

    def _m_merk(self) -> DataFrame:
        return self._names("kd_merk", "p_brand").where("kd_merk <> 'Brand#25'")

    def _m_model(self) -> DataFrame:
        return self._names("kd_model", "split_part(p_name, ' ', 2)")

    def _m_warna(self) -> DataFrame:
        return self._names("kd_warna", "split_part(p_name, ' ', 1)")

    def _m_barang_satuan(self) -> DataFrame:
        def unit(kept: str, name: str, jumlah: str, harga: str = "0", status: str = "1") -> str:
            row = ", ".join(
                [
                    f"'kd_satuan', '{name}'",
                    f"'jumlah', cast({jumlah} AS {QTY})",
                    f"'harga_jual', cast({harga} AS {PRICE})",
                    f"'status', {status}",
                ]
            )
            return f"CASE WHEN {kept} THEN named_struct({row}) END"

        price = f"cast(p_retailprice AS {PRICE})"
        off_sale = "CASE WHEN p_partkey % 20 = 7 THEN 0 ELSE 1 END"
        units = ", ".join(
            [
                unit("p_partkey % 50 <> 0", "PCS", "1", price, off_sale),
                unit("p_partkey % 3 = 0", "BOX", "12", f"{price} * 12"),
                unit("p_partkey % 10 = 4", "NOL", "0", price),
                unit("p_partkey % 10 = 5", "NUL", "NULL", price),
                unit("p_partkey % 100 = 3", "BJI", "1", f"{price} + 1"),
            ]
        )
        rows = self._raw("part").selectExpr(
            "cast(p_partkey AS string) AS kd_barang",
            f"inline(array_compact(array({units})))",
        )
        return self._on_every_site(rows)

    def _m_satuan(self) -> DataFrame:
        values = ", ".join(f"('{kode}', '{nama}')" for kode, nama in UNIT_NAMES)
        return self._on_every_site(
            self.spark.sql(f"SELECT * FROM VALUES {values} AS t(kd_satuan, nama)")
        )

    def _m_divisi(self) -> DataFrame:
        nation, region = self._nation(), self._raw("region")
        return (
            nation.where("n_nationkey <> 24")
            .join(region, nation.n_regionkey == region.r_regionkey)
            .selectExpr(
                "server_key",
                "cast(n_nationkey AS string) AS kd_divisi",
                "n_name AS nama",
                "concat(r_name, ' / ', n_name) AS keterangan",
                "concat('N', n_nationkey) AS kepala_nota",
            )
        )

    def _m_barang_divisi(self) -> DataFrame:
        # (p_partkey + n_nationkey) % 5 = 0 as an equality of residues.
        # Each item becomes a row for a fifth of all divisions: the items are dealt out before, as their file may be one task's.
        part = self._raw("part").withColumn("kd_barang", F.col("p_partkey").cast("string")).repartition("kd_barang")
        part = part.selectExpr("*", "pmod(-p_partkey, 5) AS residue")
        nation = self._nation().selectExpr("*", "cast(n_nationkey AS bigint) % 5 AS residue")
        return part.join(nation, "residue").selectExpr(
            "server_key",
            "cast(n_nationkey AS string) AS kd_divisi",
            "kd_barang",
            "CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_size END "
            "AS stok_awal",
            f"CASE WHEN p_partkey % 7 <> 0 THEN cast(p_retailprice AS {PRICE}) * 0.8BD END "
            "AS harga_beli_awal",
        )

    # ---- documents ---------------------------------------------------------

    def _owners(self, table: str, nation_key: str) -> DataFrame:
        """Customers or suppliers with the site their nation belongs to."""
        owners = self._raw(table)
        if not self.by_region:
            return owners.selectExpr("*", f"'{self.server_key}' AS server_key")
        nation = self._nation().select("n_nationkey", "server_key")
        return owners.join(nation, owners[nation_key] == nation.n_nationkey)

    def _orders(self) -> DataFrame:
        customer, orders = self._owners("customer", "c_nationkey"), self._raw("orders")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
            "o_orderkey",
            "o_orderstatus",
            "o_orderpriority",
            "o_orderdate AS tanggal",
            "cast(c_nationkey AS string) AS customer_divisi",
            "server_key AS customer_site",
        )

    def _order_header(self, key: str, lines: str) -> DataFrame:
        """Header per order; the division is the customer's nation.

        Orders and lines meet under the number of the document, so headers lie as a join with their lines wants them.
        """
        number = f"cast(o_orderkey AS string) AS {key}"
        arrived = (
            self._raw("lineitem")
            .where(lines)
            .selectExpr(f"{ORDER_KEY} AS {key}", "l_shipdate")
            .groupBy(key)
            .agg({"l_shipdate": "max"})
        )
        return (
            self._orders()
            .selectExpr(number, "customer_site", "customer_divisi", "tanggal")
            .join(arrived, key, "left")
            .selectExpr(
                "customer_site AS server_key",
                key,
                "customer_divisi AS kd_divisi",
                "tanggal",
                "`max(l_shipdate)` AS tanggal_server",
            )
        )

    def _supplier_header(self, key: str, lines: str, *columns: str) -> DataFrame:
        """Header per (order, supplier); the division is the supplier's nation."""
        documents = (
            self._raw("lineitem")
            .where(lines)
            .repartition("l_orderkey")  # One shuffle for the grouping and for the join with orders.
            .groupBy("l_orderkey", "l_suppkey")
            .agg({"l_shipdate": "max"})
        )
        orders, supplier = self._orders(), self._owners("supplier", "s_nationkey")
        return (
            documents.join(orders, documents.l_orderkey == orders.o_orderkey)
            .join(supplier, documents.l_suppkey == supplier.s_suppkey)
            .selectExpr(
                "server_key",
                f"{PAIR_KEY} AS {key}",
                "tanggal",
                "`max(l_shipdate)` AS tanggal_server",
                *columns,
            )
        )

    def _line_rows(self, key: str, lines: str, document: str, *columns: str) -> DataFrame:
        rows, site = self.lineitem.where(lines), []
        if self.by_region:
            rows, site = self._locate(rows, document == PAIR_KEY), ["server_key"]
        return rows.selectExpr(
            *site,
            f"{document} AS {key}",
            "l_linenumber AS line_no",
            "cast(l_partkey AS string) AS kd_barang",
            f"cast(l_quantity AS {QTY}) AS qty",
            UNIT_OF_LINE,
            *columns,
        )

    def _locate(self, lines: DataFrame, by_supplier: bool) -> DataFrame:
        """Give each line the site of its document."""
        if by_supplier:
            owner = self._owners("supplier", "s_nationkey").select("s_suppkey", "server_key")
            return lines.join(owner, lines.l_suppkey == owner.s_suppkey)
        owner = self._orders().selectExpr("o_orderkey", "customer_site AS server_key")
        return lines.join(owner, lines.l_orderkey == owner.o_orderkey)

    def _t_penjualan(self) -> DataFrame:
        return self._order_header("no_transaksi", SALES)

    def _t_penjualan_detail(self) -> DataFrame:
        return self._line_rows("no_transaksi", SALES, ORDER_KEY, LINE_PRICE + "harga_jual")

    def _t_penjualan_retur(self) -> DataFrame:
        return self._order_header("no_retur", SALE_RETURNS)

    def _t_penjualan_retur_detail(self) -> DataFrame:
        return self._line_rows("no_retur", SALE_RETURNS, ORDER_KEY, LINE_PRICE + "harga_jual")

    def _t_pembelian(self) -> DataFrame:
        return self._supplier_header(
            "no_transaksi",
            PURCHASES,
            "cast(s_nationkey AS string) AS kd_divisi",
            "o_orderkey % 3 AS status",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 0.02 WHEN '2-HIGH' THEN 5 END AS diskon1",
            "NULL AS diskon2",
            "NULL AS diskon3",
            "NULL AS diskon4",
            "CASE WHEN o_orderstatus = 'F' THEN 0.11 END AS pajak",
            "CASE WHEN o_orderpriority = '5-LOW' THEN 0.05 END AS ppnbm",
        )

    def _t_pembelian_detail(self) -> DataFrame:
        return self._line_rows(
            "no_transaksi",
            PURCHASES,
            PAIR_KEY,
            LINE_PRICE + "harga_beli",
            "cast(l_discount AS decimal(4,2)) AS diskon1",
            "CASE WHEN l_linenumber = 7 THEN 25 END AS diskon2",
            "NULL AS diskon3",
            "NULL AS diskon4",
        )

    def _t_pembelian_retur(self) -> DataFrame:
        division = "cast(s_nationkey AS string) AS kd_divisi"
        return self._supplier_header("no_retur", PURCHASE_RETURNS, division)

    def _t_pembelian_retur_detail(self) -> DataFrame:
        return self._line_rows("no_retur", PURCHASE_RETURNS, PAIR_KEY, LINE_PRICE + "harga")

    def _t_mutasi_stok(self) -> DataFrame:
        return self._supplier_header(
            "no_transaksi",
            TRANSFERS,
            "cast(s_nationkey AS string) AS kd_divisi_asal",
            "customer_divisi AS kd_divisi_tujuan",
        )

    def _t_mutasi_stok_detail(self) -> DataFrame:
        return self._line_rows("no_transaksi", TRANSFERS, PAIR_KEY)

    def _t_opname_stok(self) -> DataFrame:
        counts, site = self._raw("events").where("event_type IN ('purchase', 'error', 'signup')"), []
        if self.by_region:
            nation = self._nation().selectExpr("cast(n_nationkey AS bigint) AS nation", "server_key")
            counts = counts.selectExpr("*", "user_id % 25 AS nation").join(nation, "nation")
            site = ["server_key"]
        return counts.selectExpr(
            *site,
            "cast(event_id AS string) AS no_transaksi",
            "cast(user_id % 25 AS string) AS kd_divisi",
            "cast(event_id % 200 AS string) AS kd_barang",
            "ts AS tanggal",
            "value AS qty",
            "'PCS' AS kd_satuan",
            "CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS status",
        )
