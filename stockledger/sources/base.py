"""The interface every source has, and the sources made of other frames."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from stockledger import schemas

log = logging.getLogger("stockledger.sources")


class Source:
    """Named operational tables of one site or of several.

    ``on_missing="error"`` makes an absent table an error. With ``"empty"`` it counts
    as a table without rows and its name is kept in ``missing``; the item master stays
    compulsory, because nothing can be valued without it. So does a table of which a file
    cannot be read: that is asked before the table takes part in a plan, where the failure
    of one table would be the failure of the whole ledger.
    """

    compulsory = frozenset({"m_barang"})
    #: How long streamed lines and headers of a document wait for each other, as "30 days"; None: for good.
    wait: str | None = None
    #: Columns streamed lines and headers keep while they wait, besides the document's key; None: all.
    carried: frozenset[str] | None = None

    def __init__(self, spark: SparkSession, server_key: str | None, on_missing: str = "error"):
        if on_missing not in ("error", "empty"):
            raise ValueError(f"on_missing is 'error' or 'empty', not {on_missing!r}")
        self.spark = spark
        self.server_key = server_key
        self.on_missing = on_missing
        self.missing: dict[str, str] = {}
        self._tables: dict[str, DataFrame] = {}

    def exists(self, name: str) -> bool:
        raise NotImplementedError

    def _read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def unreadable(self, name: str) -> list[str]:
        """Files of a table that cannot be read; sources without files have none."""
        return []

    def table(self, name: str) -> DataFrame:
        """The declared columns of a table; the same frame each time it is asked for."""
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def _load(self, name: str) -> DataFrame:
        columns = schemas.TABLES[name]
        try:
            if not self.exists(name):
                raise FileNotFoundError(f"table {name} does not exist")
            if self.on_missing == "empty" and name not in self.compulsory:
                broken = self.unreadable(name)
                if broken:
                    raise OSError(f"table {name} cannot be read: {', '.join(broken)}")
            return self._restrict(schemas.conform(self._read(name), columns, self.server_key))
        except (OSError, ValueError, PySparkException) as problem:
            if self.on_missing == "error" or name in self.compulsory:
                raise
            self.missing[name] = str(problem)
            log.warning("%s counts as empty: %s", name, problem)
            return schemas.empty(self.spark, columns)

    def _restrict(self, df: DataFrame) -> DataFrame:
        return df if self.server_key is None else df.where(df.server_key == self.server_key)


class FrameSource(Source):
    """Tables given as DataFrames, batch or streaming."""

    def __init__(
        self,
        spark: SparkSession,
        frames: Mapping[str, DataFrame],
        server_key: str | None = "main",
        on_missing: str = "error",
    ):
        super().__init__(spark, server_key, on_missing)
        self.frames = dict(frames)

    def exists(self, name: str) -> bool:
        return name in self.frames

    def _read(self, name: str) -> DataFrame:
        return self.frames[name]


class AllSites(Source):
    """The rows of several sites in one table each, told apart by ``server_key``."""

    def __init__(self, sites: Sequence[Source]):
        super().__init__(sites[0].spark, None)
        self.sites = list(sites)

    def exists(self, name: str) -> bool:
        return any(site.exists(name) for site in self.sites)

    def _load(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [site.table(name) for site in self.sites])

    def available(self) -> list[str | None]:
        return [site.server_key for site in self.sites]
