"""DuckDB SQL of every registered query.

The first part maps the test tables to the operational tables, once for a single site
and once with a site per region. Everything is written row by row and without the
regroupings the Spark plans use, so that agreement means something.
"""

from __future__ import annotations

from ledger_checks.queries import (
    CLOSING,
    HISTORY_ITEMS,
    LAST_REFRESH,
    ORDERS_ONLY,
    WITH_COUNTS,
)

ORACLES: dict[str, str] = {}


def source_tables(by_region: bool = False) -> str:
    """CTEs of the operational tables."""
    nation_site = "CAST(n_regionkey AS VARCHAR)" if by_region else "'main'"
    sites = (
        "SELECT CAST(r_regionkey AS VARCHAR) AS server_key FROM region"
        if by_region
        else "SELECT 'main' AS server_key"
    )

    def order_header(name: str, key: str, lines: str) -> str:
        return f"""
{name} AS (
  SELECT n.server_key, CAST(o_orderkey AS VARCHAR) AS {key}, CAST(c_nationkey AS VARCHAR) AS kd_divisi,
         o_orderdate AS tanggal, a.tanggal_server
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN site_nation n ON c_nationkey = n.n_nationkey
  JOIN (SELECT l_orderkey, max(l_shipdate) AS tanggal_server FROM lineitem WHERE {lines} GROUP BY 1) a
    ON o_orderkey = a.l_orderkey
),"""

    def supplier_header(name: str, key: str, lines: str, division: str, extra: str = "") -> str:
        return f"""
{name} AS (
  SELECT n.server_key, l_orderkey || '-' || l_suppkey AS {key}, {division},
         o_orderdate AS tanggal, a.tanggal_server{extra}
  FROM (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS tanggal_server
        FROM lineitem WHERE {lines} GROUP BY 1, 2) a
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN site_nation n ON s_nationkey = n.n_nationkey
),"""

    def detail(name: str, header: str, key: str, lines: str, pair: bool, extra: str) -> str:
        document = "l_orderkey || '-' || l_suppkey" if pair else "CAST(l_orderkey AS VARCHAR)"
        return f"""
{name} AS (
  SELECT h.server_key, d.* FROM (
    SELECT {document} AS {key}, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS kd_barang,
           CAST(l_quantity AS DECIMAL(18,4)) AS qty,
           CASE l_linenumber WHEN 1 THEN 'PCS' WHEN 2 THEN 'PCS' WHEN 3 THEN 'BOX' WHEN 4 THEN 'KRT'
                WHEN 5 THEN 'NUL' WHEN 6 THEN 'NOL' END AS kd_satuan{extra}
    FROM lineitem WHERE {lines}) d
  JOIN {header} h USING ({key})
),"""

    sale, purchase = "l_returnflag = 'N'", "l_returnflag = 'A' AND l_linestatus = 'F'"
    transfer = "l_returnflag = 'A' AND l_linestatus = 'O'"
    sale_return = "l_returnflag = 'R' AND l_linestatus = 'F'"
    purchase_return = "l_returnflag = 'R' AND l_linestatus = 'O'"
    price = ",\n           CAST(l_extendedprice AS DECIMAL(18,2)) AS "
    supplier_division = "CAST(s_nationkey AS VARCHAR) AS kd_divisi"
    return f"""
site AS ({sites}),
site_nation AS (SELECT n.*, {nation_site} AS server_key FROM nation n),
m_divisi AS (
  SELECT server_key, CAST(n_nationkey AS VARCHAR) AS kd_divisi, n_name AS nama,
         r_name || ' / ' || n_name AS keterangan, 'N' || n_nationkey AS kepala_nota
  FROM site_nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24
),
m_barang AS (
  SELECT server_key, CAST(p_partkey AS VARCHAR) AS kd_barang, p_name AS nama, p_type AS kd_kategori,
         p_brand AS kd_merk, split_part(p_name, ' ', 2) AS kd_model,
         split_part(p_name, ' ', 1) AS kd_warna, CAST(p_size AS VARCHAR) AS ukuran
  FROM part CROSS JOIN site
),
m_kategori AS (
  SELECT DISTINCT server_key, kd_kategori, lower(kd_kategori) AS nama,
         CASE WHEN kd_kategori = 'PROMO' THEN 2 ELSE 1 END AS status FROM m_barang
),
m_merk AS (SELECT DISTINCT server_key, kd_merk, kd_merk AS nama FROM m_barang WHERE kd_merk <> 'Brand#25'),
m_model AS (SELECT DISTINCT server_key, kd_model, kd_model AS nama FROM m_barang),
m_warna AS (SELECT DISTINCT server_key, kd_warna, kd_warna AS nama FROM m_barang),
unit_rows AS (
  SELECT CAST(p_partkey AS VARCHAR) AS kd_barang, 'PCS' AS kd_satuan, CAST(1 AS DECIMAL(18,4)) AS jumlah,
         CAST(p_retailprice AS DECIMAL(18,2)) AS harga_jual,
         CASE WHEN p_partkey % 20 = 7 THEN 0 ELSE 1 END AS status FROM part WHERE p_partkey % 50 <> 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'BOX', 12, CAST(p_retailprice AS DECIMAL(18,2)) * 12, 1
  FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'NOL', 0, CAST(p_retailprice AS DECIMAL(18,2)), 1
  FROM part WHERE p_partkey % 10 = 4
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'NUL', NULL, CAST(p_retailprice AS DECIMAL(18,2)), 1
  FROM part WHERE p_partkey % 10 = 5
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'BJI', 1, CAST(p_retailprice AS DECIMAL(18,2)) + 1, 1
  FROM part WHERE p_partkey % 100 = 3
),
m_barang_satuan AS (SELECT server_key, u.* FROM unit_rows u CROSS JOIN site),
m_satuan AS (
  SELECT server_key, kd_satuan, nama FROM site CROSS JOIN (VALUES ('PCS', 'Pieces'), ('BOX', 'Box'),
    ('NOL', 'Nol'), ('NUL', 'Nul'), ('BJI', 'Biji')) v(kd_satuan, nama)
),
m_barang_divisi AS (
  SELECT server_key, CAST(n_nationkey AS VARCHAR) AS kd_divisi, CAST(p_partkey AS VARCHAR) AS kd_barang,
         CAST(CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_size END
              AS DECIMAL(18,4)) AS stok_awal,
         CASE WHEN p_partkey % 7 = 0 THEN NULL
              ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(18,2))
         END AS harga_beli_awal
  FROM part JOIN site_nation ON (p_partkey + n_nationkey) % 5 = 0
),{order_header("t_penjualan", "no_transaksi", sale)}{
    detail("t_penjualan_detail", "t_penjualan", "no_transaksi", sale, False, price + "harga_jual")
}{order_header("t_penjualan_retur", "no_retur", sale_return)}{
    detail("t_penjualan_retur_detail", "t_penjualan_retur", "no_retur", sale_return, False,
           price + "harga_jual")
}{supplier_header("t_pembelian", "no_transaksi", purchase, supplier_division, ''',
         o_orderkey % 3 AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0.02 WHEN '2-HIGH' THEN 5 END AS h1,
         CASE WHEN o_orderstatus = 'F' THEN 0.11 END AS pajak,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0.05 END AS ppnbm''')}{
    detail("t_pembelian_detail", "t_pembelian", "no_transaksi", purchase, True, price + '''harga_beli,
           CAST(l_discount AS DECIMAL(4,2)) AS d1, CASE WHEN l_linenumber = 7 THEN 25 END AS d2''')
}{supplier_header("t_pembelian_retur", "no_retur", purchase_return, supplier_division)}{
    detail("t_pembelian_retur_detail", "t_pembelian_retur", "no_retur", purchase_return, True,
           price + "harga")
}{supplier_header("t_mutasi_stok", "no_transaksi", transfer,
                  "CAST(s_nationkey AS VARCHAR) AS kd_divisi_asal, "
                  "CAST(c_nationkey AS VARCHAR) AS kd_divisi_tujuan")}{
    detail("t_mutasi_stok_detail", "t_mutasi_stok", "no_transaksi", transfer, True, "")
}
t_opname_stok AS (
  SELECT n.server_key, CAST(event_id AS VARCHAR) AS no_transaksi, CAST(user_id % 25 AS VARCHAR) AS kd_divisi,
         CAST(event_id % 200 AS VARCHAR) AS kd_barang, ts AS tanggal,
         CAST(value AS DECIMAL(18,4)) AS qty, 'PCS' AS kd_satuan,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS status
  FROM events JOIN site_nation n ON user_id % 25 = n.n_nationkey
  WHERE event_type IN ('purchase', 'error', 'signup')
)"""


def _ledger() -> str:
    """The nine branches, without item or category conditions."""
    closing = f"tanggal > TIMESTAMP '{CLOSING}'"
    none = "CAST(0 AS DECIMAL(18,4))"

    def branch(no, label, source, frm, division, document, line, inbound, price, where):
        qty = "stok_awal" if no == 1 else "qty"
        debet, kredit = (qty, none) if inbound else (none, qty)
        tag = f"'{source}'" if source else "CAST(NULL AS VARCHAR)"
        return (
            f"SELECT server_key, {division} AS kd_divisi, kd_barang, tanggal, tanggal_server, {no} AS branch_no, "
            f"'{label}' AS transaksi, {tag} AS source, {document} AS no_transaksi, {line} AS line_no, kd_satuan, "
            f"{debet} AS debet, {kredit} AS kredit, CAST({price} AS DECIMAL(18,2)) AS harga, "
            f"{'status' if no == 6 else 'NULL'} AS status FROM {frm} WHERE {where}"
        )

    def joined(name: str, key: str) -> str:
        return f"{name}_detail JOIN {name} USING (server_key, {key})"

    opening = (
        f"(SELECT o.*, TIMESTAMP '{CLOSING}' AS tanggal, CAST(NULL AS TIMESTAMP) AS tanggal_server, "
        "(SELECT min(u.kd_satuan) FROM m_barang_satuan u WHERE u.server_key = o.server_key "
        "AND u.kd_barang = o.kd_barang AND u.jumlah = 1) AS kd_satuan FROM m_barang_divisi o)"
    )
    counts = "(SELECT *, CAST(NULL AS TIMESTAMP) AS tanggal_server FROM t_opname_stok)"
    rows = [
        branch(1, "Stok Awal", None, opening, "kd_divisi", "'0'", "NULL", True, "harga_beli_awal", "true"),
        branch(2, "Mutasi Keluar", "mutasi_out", joined("t_mutasi_stok", "no_transaksi"), "kd_divisi_asal",
               "no_transaksi", "line_no", False, "0", closing),
        branch(3, "Mutasi Masuk", "mutasi_in", joined("t_mutasi_stok", "no_transaksi"), "kd_divisi_tujuan",
               "no_transaksi", "line_no", True, "0", closing),
        branch(4, "Opname Masuk", None, counts, "kd_divisi", "no_transaksi", "NULL", True, "0",
               closing + " AND status = 2"),
        branch(5, "Opname Keluar", None, counts, "kd_divisi", "no_transaksi", "NULL", False, "0",
               closing + " AND status <> 2"),
        branch(6, "Pembelian", "pembelian", joined("t_pembelian", "no_transaksi"), "kd_divisi",
               "no_transaksi", "line_no", True, "harga_beli", closing),
        branch(7, "Retur Pembelian", "retur_beli", joined("t_pembelian_retur", "no_retur"), "kd_divisi",
               "no_retur", "line_no", False, "harga", closing),
        branch(8, "Penjualan", "penjualan", joined("t_penjualan", "no_transaksi"), "kd_divisi",
               "no_transaksi", "line_no", False, "harga_jual", closing),
        branch(9, "Retur Penjualan", "retur_jual", joined("t_penjualan_retur", "no_retur"), "kd_divisi",
               "no_retur", "line_no", True, "harga_jual", closing),
    ]
    union = "\n  UNION ALL ".join(rows)
    factor = "u.jumlah AS jumlah"
    return f""",
branches AS (
  {union}
),
ledger AS (
  SELECT l.*, {factor}, CASE WHEN u.jumlah IS NULL OR u.jumlah = 0 THEN 1 ELSE u.jumlah END AS konversi,
         b.nama AS barang, k.status AS kategori_status
  FROM branches l
  LEFT JOIN m_barang_satuan u USING (server_key, kd_barang, kd_satuan)
  LEFT JOIN m_barang b USING (server_key, kd_barang)
  LEFT JOIN m_kategori k USING (server_key, kd_kategori)
),
sale_units AS (
  SELECT server_key, kd_barang, kd_satuan, harga_jual FROM (
    SELECT *, row_number() OVER (PARTITION BY server_key, kd_barang ORDER BY kd_satuan, harga_jual) AS rn
    FROM m_barang_satuan WHERE jumlah = 1 AND status <> 0) WHERE rn = 1
),
master AS (
  SELECT b.server_key, b.kd_barang, b.nama, b.kd_kategori, b.kd_merk, b.kd_model, b.kd_warna, b.ukuran,
         k.nama AS kategori, mk.nama AS merk, mo.nama AS model, w.nama AS warna,
         s.harga_jual, s.kd_satuan AS kd_satuan_terkecil
  FROM m_barang b JOIN m_kategori k USING (server_key, kd_kategori) JOIN m_merk mk USING (server_key, kd_merk)
  JOIN m_model mo USING (server_key, kd_model) JOIN m_warna w USING (server_key, kd_warna)
  JOIN sale_units s USING (server_key, kd_barang)
  WHERE k.status <> 2
),
last_buy AS (
  SELECT server_key, kd_barang, harga_beli FROM (
    SELECT d.server_key, d.kd_barang, d.harga_beli,
           row_number() OVER (PARTITION BY d.server_key, d.kd_barang ORDER BY tanggal DESC NULLS LAST,
             no_transaksi DESC, line_no DESC NULLS LAST, kd_satuan DESC NULLS LAST, qty DESC NULLS LAST,
             harga_beli DESC NULLS LAST) AS rn
    FROM t_pembelian_detail d JOIN t_pembelian h USING (server_key, no_transaksi)) WHERE rn = 1
),
average AS (
  SELECT server_key, kd_barang, CASE WHEN sum(qty) > 0
    THEN CAST(CAST(sum(qty * harga_beli) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS DECIMAL(24,6))
    ELSE 0 END AS harga_avg
  FROM t_pembelian_detail GROUP BY 1, 2
)"""


def statement(tail: str, by_region: bool = False) -> str:
    return "WITH " + source_tables(by_region).strip() + _ledger() + tail


def _as_of(day: str) -> str:
    return f"CAST(tanggal AS DATE) <= DATE '{day}'"


def _stock(condition: str) -> str:
    """Stock per key in the snapshot's rules."""
    return f"""
SELECT l.server_key, l.kd_divisi, l.kd_barang,
       round(sum((coalesce(debet, 0) - coalesce(kredit, 0)) * CAST(konversi AS DECIMAL(13,4))), 4) AS stok
FROM ledger l WHERE {condition} GROUP BY 1, 2, 3"""


def _snapshot(condition: str) -> str:
    return f"""
SELECT s.server_key, s.kd_divisi, coalesce(d.nama, s.kd_divisi) AS divisi, s.kd_barang,
       m.nama AS barang, m.kategori, m.merk, m.model, m.warna, m.ukuran,
       CAST(s.stok AS DOUBLE) AS stok_akhir, CAST(m.harga_jual AS DOUBLE) AS harga_jual,
       CAST(coalesce(p.harga_beli, 0) AS DOUBLE) AS harga_beli_akhir,
       CAST(round(coalesce(a.harga_avg, 0), 2) AS DOUBLE) AS harga_avg
FROM ({_stock(condition)}) s JOIN master m USING (server_key, kd_barang)
LEFT JOIN m_divisi d USING (server_key, kd_divisi)
LEFT JOIN last_buy p USING (server_key, kd_barang)
LEFT JOIN average a USING (server_key, kd_barang)"""


SNAPSHOT_COUNTS = f"branch_no <> 5 AND {_as_of(WITH_COUNTS)}"
SNAPSHOT_ORDERS = f"branch_no <> 5 AND {_as_of(ORDERS_ONLY)}"
IN_BASE = f"{SNAPSHOT_ORDERS} AND (tanggal_server IS NULL OR tanggal_server <= TIMESTAMP '{LAST_REFRESH}')"
IN_FEED = f"source IS NOT NULL AND {_as_of(ORDERS_ONLY)} AND tanggal_server > TIMESTAMP '{LAST_REFRESH}'"
HISTORY_ROWS = (
    "(branch_no <> 6 OR status IN (0, 1)) AND (branch_no NOT IN (1, 8) OR kategori_status <> 2)"
)

# ---- sources, master and prices --------------------------------------------

ORACLES["division_scan"] = statement(
    " SELECT kd_divisi, nama FROM m_divisi WHERE keterangan LIKE 'A%'"
)
ORACLES["unit_scan"] = statement(
    " SELECT kd_barang, kd_satuan, CAST(jumlah AS DOUBLE) AS jumlah FROM m_barang_satuan"
)
ORACLES["master_items"] = statement(
    " SELECT * REPLACE (CAST(harga_jual AS DOUBLE) AS harga_jual) FROM master"
)
ORACLES["last_buy_price"] = statement(
    " SELECT server_key, kd_barang, CAST(harga_beli AS DOUBLE) AS harga_beli FROM last_buy"
)
ORACLES["weighted_avg_price"] = statement(
    " SELECT server_key, kd_barang, CAST(round(harga_avg, 4) AS DOUBLE) AS harga_avg FROM average"
)


def _percent(discount: str) -> str:
    return f"CASE WHEN abs({discount}) < 1 THEN 1 - {discount} ELSE 1 END"


def _amount(discount: str) -> str:
    return f"CASE WHEN abs({discount}) >= 1 THEN {discount} ELSE 0 END"


_D1, _D2, _H1 = (f"coalesce(CAST({c} AS DOUBLE), 0)" for c in ("d1", "d2", "h1"))
PURCHASE_LAYERS = f"""
SELECT server_key, no_transaksi, line_no, kd_barang, tanggal, 'PEMBELIAN' AS jenis,
       CAST(qty * CAST(coalesce(jumlah, 1) AS DECIMAL(13,4)) AS DOUBLE) AS stok,
       CASE WHEN coalesce(jumlah, 1) = 0 THEN 0 ELSE
         (CASE WHEN harga_beli <= 0 THEN 0 ELSE
            CAST(harga_beli AS DOUBLE) * ({_percent(_D1)}) * ({_percent(_D2)})
            - ({_amount(_D1)}) - ({_amount(_D2)}) END)
         * ({_percent(_H1)}) * (1 + coalesce(CAST(pajak AS DOUBLE), 0)) * (1 + coalesce(CAST(ppnbm AS DOUBLE), 0))
         / CAST(coalesce(jumlah, 1) AS DOUBLE) END AS harga
FROM t_pembelian_detail JOIN t_pembelian USING (server_key, no_transaksi)
LEFT JOIN (SELECT server_key, kd_barang, kd_satuan, jumlah FROM m_barang_satuan)
  USING (server_key, kd_barang, kd_satuan)"""

ORACLES["net_buy_price"] = statement(f"""
SELECT no_transaksi, line_no, kd_barang, strftime(tanggal, '%Y-%m-%d %H:%M:%S') AS tanggal, stok, harga
FROM ({PURCHASE_LAYERS})""")

_LAYER_DAYS = f"CAST(tanggal AS DATE) BETWEEN DATE '{CLOSING[:10]}' AND DATE '{WITH_COUNTS}'"
ORACLES["inbound_layers"] = statement(f"""
SELECT kd_barang, strftime(tanggal, '%Y-%m-%d %H:%M:%S') AS tanggal, jenis, stok, harga FROM (
  SELECT kd_barang, TIMESTAMP '{CLOSING}' AS tanggal, 'STOK_AWAL' AS jenis,
         CAST(sum(coalesce(stok_awal, 0)) AS DOUBLE) AS stok,
         CASE WHEN count(CASE WHEN stok_awal > 0 THEN harga_beli_awal END) > 0 THEN
           CAST(CAST(CAST(sum(CASE WHEN stok_awal > 0 THEN harga_beli_awal END) AS DOUBLE)
             / count(CASE WHEN stok_awal > 0 THEN harga_beli_awal END) AS DECIMAL(24,6)) AS DOUBLE)
           ELSE 0 END AS harga
  FROM m_barang_divisi GROUP BY kd_barang
  UNION ALL
  SELECT kd_barang, tanggal, 'OPNAME', CAST(qty * CAST(coalesce(jumlah, 1) AS DECIMAL(13,4)) AS DOUBLE), 0
  FROM t_opname_stok o
  LEFT JOIN (SELECT kd_barang, kd_satuan, jumlah FROM m_barang_satuan) USING (kd_barang, kd_satuan)
  WHERE status = 2 AND {_LAYER_DAYS}
  UNION ALL
  SELECT kd_barang, tanggal, jenis, stok, harga FROM ({PURCHASE_LAYERS}) WHERE {_LAYER_DAYS})""")

ORACLES["stock_per_item"] = statement(f"""
SELECT server_key, kd_barang,
       CAST(round(sum(CAST(coalesce(jumlah, 1) AS DECIMAL(13,4)) * (debet - kredit)), 4) AS DOUBLE) AS stok_akhir
FROM ledger WHERE {HISTORY_ROWS} AND {_as_of(WITH_COUNTS)} GROUP BY 1, 2""")

# ---- movements -------------------------------------------------------------

for _name, _branches in {
    "mv_opening": "1",
    "mv_sales": "8",
    "mv_purchases": "6",
    "mv_opname_in": "4",
    "mv_opname_out": "5",
    "mv_transfer": "2, 3",
    "mv_returns": "7, 9",
}.items():
    ORACLES[_name] = statement(f"""
SELECT kd_divisi, kd_barang, transaksi, count(*) AS baris, CAST(sum(debet) AS DOUBLE) AS debet,
       CAST(sum(kredit) AS DOUBLE) AS kredit
FROM branches WHERE branch_no IN ({_branches}) AND (branch_no <> 6 OR status IN (0, 1))
  AND {_as_of(WITH_COUNTS)} GROUP BY 1, 2, 3""")

ORACLES["ledger_all"] = statement("""
SELECT branch_no, transaksi, kd_divisi, count(*) AS baris, CAST(sum(debet) AS DOUBLE) AS debet,
       CAST(sum(kredit) AS DOUBLE) AS kredit
FROM branches WHERE branch_no <> 6 OR status IN (0, 1) GROUP BY 1, 2, 3""")

# ---- snapshot --------------------------------------------------------------

ORACLES["snapshot_full"] = statement(_snapshot(SNAPSHOT_COUNTS))
ORACLES["snapshot_orders_only"] = statement(_snapshot(SNAPSHOT_ORDERS))
ORACLES["multi_server_snapshot"] = statement(_snapshot(SNAPSHOT_COUNTS), by_region=True)
ORACLES["stock_as_of"] = statement(f"""
SELECT l.server_key, l.kd_divisi AS "Kode Divisi", d.nama AS "Divisi", l.kd_barang AS "Kode Barang",
       m.nama AS "Barang", m.kategori AS "Kategori", m.merk AS "Merk", m.model AS "Model",
       m.warna AS "Warna", m.ukuran AS "Ukuran",
       CAST(round(sum(CAST(coalesce(l.jumlah, 1) AS DECIMAL(13,4)) * (debet - kredit)), 4) AS DOUBLE)
         AS "Stok Akhir",
       CAST(m.harga_jual AS DOUBLE) AS "Harga Jual",
       CAST(coalesce(p.harga_beli, (SELECT max(o.harga_beli_awal) FROM m_barang_divisi o
         WHERE o.kd_barang = l.kd_barang), 0) AS DOUBLE) AS "Harga Beli Akhir"
FROM ledger l JOIN m_divisi d USING (server_key, kd_divisi) JOIN master m USING (server_key, kd_barang)
LEFT JOIN last_buy p USING (server_key, kd_barang)
WHERE {HISTORY_ROWS} AND CAST(tanggal AS DATE) < DATE '{ORDERS_ONLY}' + 1
GROUP BY l.server_key, l.kd_divisi, d.nama, l.kd_barang, m.nama, m.kategori, m.merk, m.model, m.warna,
         m.ukuran, m.harga_jual, p.harga_beli""")

# ---- delta -----------------------------------------------------------------

ORACLES["delta_rows"] = statement(f"""
SELECT server_key, kd_divisi, kd_barang, CAST(debet AS DOUBLE) AS debet, CAST(kredit AS DOUBLE) AS kredit,
       kd_satuan, source
FROM branches WHERE {IN_FEED}""")
ORACLES["delta_by_source"] = statement(f"""
SELECT server_key, source, count(*) AS row_count, CAST(sum(debet) AS DOUBLE) AS debet,
       CAST(sum(kredit) AS DOUBLE) AS kredit
FROM branches WHERE {IN_FEED} GROUP BY 1, 2""")
ORACLES["delta_accum"] = statement(f"""
SELECT server_key, kd_divisi, kd_barang, CAST(stok AS DOUBLE) AS delta_stok FROM ({_stock(IN_FEED)})""")
_APPLIED = f"""
SELECT b.* REPLACE (CAST(round(CAST(b.stok_akhir AS DECIMAL(24,4)) + coalesce(d.stok, 0), 4) AS DOUBLE)
  AS stok_akhir)
FROM ({_snapshot(IN_BASE)}) b LEFT JOIN ({_stock(IN_FEED)}) d USING (server_key, kd_divisi, kd_barang)"""
ORACLES["delta_applied"] = statement(_APPLIED)
ORACLES["delta_refreshed_store"] = ORACLES["delta_applied"]
ORACLES["delta_stream"] = ORACLES["delta_applied"]
ORACLES["stream_late_headers"] = ORACLES["delta_applied"]
ORACLES["delta_unmatched"] = statement(f"""
SELECT d.server_key, d.kd_divisi, d.kd_barang, CAST(d.stok AS DOUBLE) AS delta_stok
FROM ({_stock(IN_FEED)}) d ANTI JOIN ({_snapshot(IN_BASE)}) b USING (server_key, kd_divisi, kd_barang)""")
ORACLES["snapshot_info"] = statement(f"""
SELECT 'main' AS server_key, CAST(1 AS BIGINT) AS version, 'delta' AS kind, '{ORDERS_ONLY}' AS tanggal,
       '2100-01-01 00:00:00' AS last_refresh,
       (SELECT count(*) FROM ({_snapshot(IN_BASE)})) AS row_count,
       (SELECT count(*) FROM branches WHERE {IN_FEED}) AS delta_rows,
       (SELECT count(*) FROM ({_stock(IN_FEED)}) d SEMI JOIN ({_snapshot(IN_BASE)}) b
          USING (server_key, kd_divisi, kd_barang)) AS updated_keys""")

# A delta after a stream, or without a base, is a full refresh of all documents.
ORACLES["store_stream_then_batch"] = ORACLES["delta_on_empty_store"] = ORACLES["snapshot_orders_only"]
ORACLES["store_two_sites"] = statement(f"SELECT * FROM ({_APPLIED}) WHERE server_key IN ('0', '3')", by_region=True)
ORACLES["delta_empty"] = statement(f"""
SELECT 'main' AS server_key, CAST(1 AS BIGINT) AS version, 'delta' AS kind, '{ORDERS_ONLY}' AS tanggal,
       '2100-01-02 00:00:00' AS last_refresh,
       (SELECT count(*) FROM ({_snapshot(SNAPSHOT_ORDERS)})) AS row_count,
       CAST(0 AS BIGINT) AS delta_rows, CAST(0 AS BIGINT) AS updated_keys""")

# ---- reports ---------------------------------------------------------------


def _report(condition: str = "true") -> str:
    return f"""
SELECT server_key, kd_divisi AS "Kode Divisi", divisi AS "Divisi", kd_barang AS "Kode Barang",
       barang AS "Barang", kategori AS "Kategori", merk AS "Merk", model AS "Model", warna AS "Warna",
       ukuran AS "Ukuran", stok_akhir AS "Stok Akhir", harga_avg AS "Harga Average",
       harga_jual AS "Harga Jual",
       CAST(round(CAST(stok_akhir AS DECIMAL(18,4)) * CASE WHEN harga_avg <> 0
         THEN CAST(harga_avg AS DECIMAL(18,2)) ELSE CAST(harga_beli_akhir AS DECIMAL(18,2)) END, 2) AS DOUBLE)
         AS "Nominal",
       harga_beli_akhir AS "Harga Beli Akhir"
FROM ({_snapshot(SNAPSHOT_COUNTS)}) WHERE {condition}"""


ORACLES["report_all"] = statement(_report())
ORACLES["kpi_summary"] = statement(f"""
SELECT count(*) AS total_items, CAST(sum(CAST("Nominal" AS DECIMAL(28,2))) AS DOUBLE) AS total_nominal,
       count(DISTINCT "Divisi") AS divisi_count,
       CAST(round(CAST(CAST(sum(CAST("Stok Akhir" AS DECIMAL(24,4))) AS DOUBLE) / count(*)
         AS DECIMAL(24,6)), 2) AS DOUBLE) AS avg_stok,
       array_to_string(list_sort(list(DISTINCT "Divisi")), ', ') AS divisi_list
FROM ({_report()})""")
ORACLES["low_stock"] = statement(_report("stok_akhir > 0 AND stok_akhir < 10"))
for _name, _condition in {
    "search_code_prefix": "starts_with(kd_barang, '10')",
    "search_name_contains": "contains(lower(barang), 'd wid')",
    "search_name_underscore": "contains(lower(barang), 'd_wid')",
    "search_suffix": "suffix(lower(barang), 'ring')",
    "search_exact": "kd_barang = '106' OR lower(barang) = 'red widget'",
    "search_division": "starts_with(lower(barang), 'red') AND lower(divisi) = 'nation_7'",
}.items():
    ORACLES[_name] = statement(_report(_condition))

ORACLES["report_stored"] = ORACLES["report_all"]
ORACLES["low_stock_stored"] = ORACLES["low_stock"]
ORACLES["report_order"] = f"""
SELECT *, row_number() OVER (PARTITION BY server_key ORDER BY divisi, barang, kd_divisi, kd_barang) AS urutan
FROM ({ORACLES["snapshot_full"]})"""
ORACLES["kpi_stored"] = ORACLES["kpi_summary"]
ORACLES["search_stored"] = ORACLES["search_code_prefix"]

# ---- histories -------------------------------------------------------------

_TIES = ", ".join(
    f"{c} NULLS FIRST"
    for c in ("branch_no", "no_transaksi", "line_no", "kd_satuan", "debet", "kredit", "harga")
)
_LEDGER_ORDER = f"kd_divisi, tanggal NULLS FIRST, {_TIES}"
_MOMENT = "coalesce(tanggal, TIMESTAMP '1970-01-01')"


def _history(condition: str = "true", known_only: bool = False) -> str:
    label = (
        "transaksi"
        if known_only
        else "CASE WHEN branch_no = 9 THEN 'Retur Penjualan Dengan Nota' ELSE transaksi END"
    )
    join = "JOIN" if known_only else "LEFT JOIN"
    return f"""
SELECT l.server_key, coalesce(l.kd_divisi, '') AS kd_divisi, coalesce(d.keterangan, '') AS divisi,
       coalesce(d.kepala_nota, '') AS kepala_nota, tanggal, {label} AS transaksi, no_transaksi, kd_barang,
       coalesce(barang, '') AS barang, coalesce(debet, 0) AS debet, coalesce(kredit, 0) AS kredit,
       l.kd_satuan, coalesce(s.nama, '') AS satuan, coalesce(harga, 0) AS harga,
       CAST(konversi AS DECIMAL(13,4)) AS konversi, branch_no, line_no
FROM ledger l {join} m_divisi d USING (server_key, kd_divisi)
LEFT JOIN m_satuan s USING (server_key, kd_satuan)
WHERE {HISTORY_ROWS} AND {condition}"""


def _converted(rows: str) -> str:
    return f"""
SELECT * REPLACE (debet * konversi AS debet, kredit * konversi AS kredit,
  CASE WHEN konversi <> 1 THEN satuan || ' (Conv)' ELSE satuan END AS satuan) FROM ({rows})"""


def _with_balance(rows: str, order: str = _LEDGER_ORDER, group: str = "server_key, kd_barang") -> str:
    over = f"OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"SELECT *, sum(debet - kredit) {over} AS saldo, row_number() {over} AS no FROM ({rows})"


def _shown(rows: str, *extra: str) -> str:
    numbers = ", ".join(
        f"CAST(round({c}, 4) AS DOUBLE) AS {c}" for c in ("debet", "kredit", "harga", "konversi")
    )
    tail = "".join(
        f", CAST(round({c}, 4) AS DOUBLE) AS {c}" if c == "saldo" else f", {c}" for c in extra
    )
    return statement(f"""
SELECT server_key, kd_divisi, divisi, kepala_nota, strftime(tanggal, '%Y-%m-%d %H:%M:%S') AS tanggal,
       transaksi, no_transaksi, kd_barang, barang, kd_satuan, satuan, {numbers}{tail}
FROM ({rows})""")


_ITEMS = ", ".join(f"'{item}'" for item in HISTORY_ITEMS)
ORACLES["history_item"] = _shown(_with_balance(_history(f"kd_barang IN ({_ITEMS})")), "no")
ORACLES["history_division"] = _shown(_with_balance(_history("l.kd_divisi IN ('7', '24')")), "no")
ORACLES["history_all"] = _shown(_with_balance(_history()), "no")
ORACLES["history_view"] = _shown(_with_balance(_history("barang IS NOT NULL", True)), "no")
_EACH_UNIT = """
SELECT h.* REPLACE (u.kd_satuan AS kd_satuan, s.nama AS satuan) FROM ({rows}) h
JOIN m_barang_satuan u ON u.server_key = h.server_key AND u.kd_barang = h.kd_barang AND u.jumlah = 1
LEFT JOIN m_satuan s ON s.server_key = u.server_key AND s.kd_satuan = u.kd_satuan
UNION ALL {others}""".format(rows=_history("branch_no = 1"), others=_history("branch_no <> 1"))
ORACLES["history_base_units"] = _shown(_with_balance(_EACH_UNIT), "no")
ORACLES["history_range"] = _shown(
    _with_balance(_history("CAST(tanggal AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1999-02-28'")),
    "no",
    "saldo",
)
ORACLES["history_balance"] = _shown(_with_balance(_history()), "no", "saldo")
ORACLES["history_balance_converted"] = _shown(_with_balance(_converted(_history())), "no", "saldo")
ORACLES["history_balance_per_division"] = _shown(
    _with_balance(_history(), group="server_key, kd_barang, kd_divisi"), "no", "saldo"
)
ORACLES["history_balance_by_date"] = _shown(
    _with_balance(_history(), f"{_MOMENT}, {_LEDGER_ORDER}"), "no", "saldo"
)
ORACLES["history_balance_by_date_desc"] = _shown(
    _with_balance(_history(), f"{_MOMENT} DESC, {_LEDGER_ORDER}"), "no", "saldo"
)
ORACLES["history_unit_filter"] = _shown(
    _with_balance(_converted(f"SELECT * FROM ({_history()}) WHERE satuan = 'Box'")), "no", "saldo"
)
for _name, _order in {
    "history_sorted_nulls_last": "kd_satuan DESC NULLS LAST, no",
    "history_sorted_by_date_asc": f"{_MOMENT}, no",
    "history_sorted_by_date_desc": f"{_MOMENT} DESC, no",
    "history_sorted_by_number": "debet NULLS LAST, no",
    "history_sorted_by_balance": "no",
}.items():
    _sorted = f"""
SELECT * EXCLUDE (saldo), sum(debet - kredit) OVER o AS saldo, row_number() OVER o AS urutan
FROM ({_with_balance(_history())})
WINDOW o AS (PARTITION BY server_key, kd_barang ORDER BY {_order} ROWS UNBOUNDED PRECEDING)"""
    ORACLES[_name] = _shown(_sorted, "no", "urutan", "saldo")
ORACLES["history_totals"] = statement(f"""
SELECT server_key, kd_barang, CAST(sum(debet) AS DOUBLE) AS total_debet,
       CAST(sum(kredit) AS DOUBLE) AS total_kredit, CAST(sum(debet - kredit) AS DOUBLE) AS saldo_akhir
FROM ({_converted(_history())}) GROUP BY 1, 2""")
ORACLES["history_units"] = statement(
    f"SELECT DISTINCT server_key, kd_barang, satuan FROM ({_history()}) WHERE satuan <> ''"
)

# ---- exports and sources ---------------------------------------------------

ORACLES["export_stock"] = statement(f"SELECT * EXCLUDE (server_key) FROM ({_report()})")


def _history_file(rows: str) -> str:
    numbers = ", ".join(
        f'CAST(round({c}, 4) AS DOUBLE) AS "{h}"'
        for c, h in {"debet": "Debet", "kredit": "Kredit", "harga": "Harga", "saldo": "Saldo", "konversi": "Konversi"}.items()
    )
    return statement(f"""
SELECT kd_divisi AS "Kd_Divisi", divisi AS "Divisi", kepala_nota AS "K.Nota",
       strftime(tanggal, '%Y-%m-%d %H:%M:%S') AS "Tanggal", transaksi AS "Transaksi",
       no_transaksi AS "No. Transaksi", kd_barang AS "Kd_Barang", barang AS "Barang",
       kd_satuan AS "Kd_Satuan", satuan AS "Satuan", {numbers}
FROM ({_with_balance(rows)})""")


ORACLES["export_history"] = _history_file(_history(f"kd_barang IN ({_ITEMS})"))
ORACLES["export_history_converted"] = _history_file(_converted(_history(f"kd_barang IN ({_ITEMS})")))
ORACLES["ledger_without_returns"] = statement("""
SELECT branch_no, transaksi, kd_divisi, count(*) AS baris, CAST(sum(debet) AS DOUBLE) AS debet,
       CAST(sum(kredit) AS DOUBLE) AS kredit
FROM branches WHERE (branch_no <> 6 OR status IN (0, 1)) AND branch_no NOT IN (7, 9) GROUP BY 1, 2, 3""")
ORACLES["ledger_corrupt_returns"] = statement("""
SELECT branch_no, transaksi, kd_divisi, count(*) AS baris, CAST(sum(debet) AS DOUBLE) AS debet,
       CAST(sum(kredit) AS DOUBLE) AS kredit, 't_penjualan_retur_detail,part-broken.parquet' AS dilewati
FROM branches WHERE (branch_no <> 6 OR status IN (0, 1)) AND branch_no <> 9 GROUP BY 1, 2, 3""")
ORACLES["costing_both"] = f"""
SELECT 'stok_akhir' AS hasil, kd_barang, CAST(NULL AS VARCHAR) AS tanggal, CAST(NULL AS VARCHAR) AS jenis,
       stok_akhir AS stok, CAST(NULL AS DOUBLE) AS harga FROM ({ORACLES["stock_per_item"]})
UNION ALL
SELECT 'histori_masuk', kd_barang, tanggal, jenis, stok, harga FROM ({ORACLES["inbound_layers"]})"""
