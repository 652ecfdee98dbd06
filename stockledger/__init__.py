"""Stock ledger on Spark: snapshots, deltas, reports, histories and cost layers."""

from stockledger.params import LedgerWindow
from stockledger.session import build_session

__all__ = ["LedgerWindow", "build_session"]
