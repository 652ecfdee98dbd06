"""Opening rows are made in as many tasks as there are shuffle partitions, not in one for the file of items."""

from stockledger.operators import movements
from stockledger.params import LedgerWindow
from stockledger.sources.testdata import TestdataSource


def test_items_are_dealt_before_they_become_rows(spark):
    source = TestdataSource(spark, "/root/testdata/sf0.001")
    ledger = movements.opening(source, LedgerWindow("1996-12-31 00:00:00"))
    lines = ledger.groupBy("kd_divisi", "kd_barang").count()._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [x for x in lines if "hashpartitioning" in x]
    assert len(dealt) == 1 and "hashpartitioning(kd_barang" in dealt[0]  # The sums need no shuffle of the rows.
