"""Parameterised SQL over the tables of a source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from stockledger import schemas
from stockledger.sources.base import Source


def run_statement(
    source: Source, statement: str, params: Sequence | Mapping | None = None
) -> DataFrame:
    """Run one statement; table names in braces are the tables of the source.

    ``run_statement(src, "select nama from {m_divisi} where kd_divisi = ?", ["7"])``.
    Values are bound by Spark, by position (``?``) or by name (``:name``).
    """
    tables = {
        name: source.table(name) for name in schemas.TABLES if "{" + name + "}" in statement
    }
    args = params if isinstance(params, Mapping) else list(params) if params else None
    return source.spark.sql(statement, args=args, **tables)


def run_statements(
    source: Source, statements: Mapping[str, str], params: Sequence | Mapping | None = None
) -> dict[str, DataFrame]:
    """Several result sets, each under its name."""
    return {
        name: run_statement(source, statement, params) for name, statement in statements.items()
    }
