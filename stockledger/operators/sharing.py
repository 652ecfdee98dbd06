"""Several aggregations of one shuffle.

Spark reuses a shuffle only where two branches of a plan ask for the same columns of it. An
aggregation that needs few of them would have the rest pruned, and with them the chance: its
input would be read, joined and shuffled a second time. A hash that names the columns
keeps them. It costs a few nanoseconds a row and is dropped with the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMED = "__named"


def naming(*columns: str) -> Column:
    """An aggregate that needs ``columns``; its result has to go through ``unnamed``."""
    return F.max(F.hash(*columns)).alias(_NAMED)


def unnamed(grouped: DataFrame) -> DataFrame:
    """Grouped rows without the hash. Every group has one, so the condition, which the optimizer cannot see through, keeps all."""
    return grouped.where(F.col(_NAMED).isNotNull()).drop(_NAMED)
