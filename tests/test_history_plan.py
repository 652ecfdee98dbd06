"""With broadcasts off, the rows of a history are read once, shuffled once and joined once."""

import pytest

from stockledger.plans import history as H
from tests.conftest import CLOSING, dimensions, item, sale, split, unit


BOXES = lambda h: H.with_unit(h, "Box")


@pytest.fixture()
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("shaped", [H.with_balance, H.with_balance_by_date, lambda h: H.with_balance(h, True)])
@pytest.mark.parametrize("step", [lambda h: h, H.converted, BOXES])
def test_rows_meet_one_join(spark, tables, no_broadcasts, shaped, step):
    source = tables(
        **dimensions(),
        m_barang=[item("1")],
        m_barang_satuan=[unit("1", "PCS", 1), unit("1", "BOX", 12)],
        m_barang_divisi=[{"kd_divisi": "A", "kd_barang": "1", "stok_awal": 10, "harga_beli_awal": 3}],
        **split("t_penjualan", [sale("S1", "A", "1", 2, "BOX"), sale("S2", "B", "1", 1)]),
    )
    found = shaped(step(H.movement_history(source, CLOSING)))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    # The classes are summed from the shuffle of the rows, not from a second reading of them.
    # (A filter by unit is pushed into one of the two where the tables are literals, as here.)
    if step is not BOXES:
        assert [x for x in lines if "ReusedExchange" in x and "no_transaksi" in x and "__level0" in x]
    last = "__level1" if shaped is not H.with_balance_by_date else "__level2"
    joins = [x for x in lines if "Join" in x and last in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
