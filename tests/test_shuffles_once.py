"""With broadcasts off, headers and purchase lines are not shuffled again for the join they were dealt for."""

import pytest

from stockledger.operators import movements, purchases
from stockledger.params import LedgerWindow
from stockledger.sources.testdata import TestdataSource


@pytest.fixture()
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_purchase_lines_are_shuffled_once_for_all_prices(spark, no_broadcasts):
    source = TestdataSource(spark, "/root/testdata/sf0.001")
    lines = _plan(purchases.last_buy_price(source))
    again = [a for a, b in zip(lines, lines[1:]) if "ENSURE_REQUIREMENTS" in a and "Exchange" in b]
    assert not again


@pytest.mark.parametrize("branch", [movements.SALE, movements.SALE_RETURN])
def test_headers_of_orders_lie_as_their_lines_want_them(spark, no_broadcasts, branch):
    source = TestdataSource(spark, "/root/testdata/sf0.001")
    window = LedgerWindow("1996-12-31 00:00:00", "2000-06-30").known_at("2000-01-01 00:00:00")
    ledger = movements.movements(source, window, movements.HISTORY_POLICY.only(branch))
    shuffles = [x for x in _plan(ledger) if "Exchange hashpartitioning" in x]
    # Orders and customers meet; orders, arrivals and lines are dealt by document, once each.
    by_document = [x for x in shuffles if "no_transaksi" in x or "no_retur" in x]
    assert len(shuffles) == 5 and len(by_document) == 3
