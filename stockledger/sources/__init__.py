"""Where the operational tables come from."""

from stockledger.sources.base import AllSites, FrameSource, Source
from stockledger.sources.statements import run_statement, run_statements
from stockledger.sources.tables import CatalogSource, JdbcSource, ParquetSource

__all__ = [
    "AllSites",
    "CatalogSource",
    "FrameSource",
    "JdbcSource",
    "ParquetSource",
    "Source",
    "run_statement",
    "run_statements",
]
