"""Tables read from parquet folders, from a Spark catalog, or over JDBC."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from stockledger import schemas
from stockledger.sources.base import Source


class ParquetSource(Source):
    """One folder (or ``.parquet`` file) per table below ``root``.

    Tables of several sites are partitioned by ``server_key``; choosing a site is then
    a partition filter. Without ``server_key`` all sites are read.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        server_key: str | None = None,
        on_missing: str = "error",
    ):
        super().__init__(spark, server_key, on_missing)
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str | None:
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for candidate in (f"{self.root}/{name}", f"{self.root}/{name}.parquet"):
            path = jvm.org.apache.hadoop.fs.Path(candidate)
            if path.getFileSystem(conf).exists(path):
                return candidate
        return None

    def exists(self, name: str) -> bool:
        return self._path(name) is not None

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException as problem:
            # The folder is there, but holds no file yet: a table without rows.
            if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return schemas.empty(self.spark, schemas.TABLES[name])

    def unreadable(self, name: str) -> list[str]:
        """Files whose footer cannot be read. Tasks read the footers, and only them; files are told apart if one fails."""
        path, schema = self._path(name), schemas.ddl(schemas.TABLES[name])
        files = self.spark.read.schema(schema).parquet(path)
        try:
            files.count()
            return []
        except (PySparkException, Py4JJavaError):
            lenient = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
            readable = {r.file_path for r in lenient.select("_metadata.file_path").distinct().collect()}
        return [file for file in sorted(set(files.inputFiles()) - readable) if not self._is_readable(file, schema)]

    def _is_readable(self, file: str, schema: str) -> bool:
        try:
            self.spark.read.schema(schema).parquet(file).count()
            return True
        except (PySparkException, Py4JJavaError):
            return False


class CatalogSource(Source):
    """Tables of a Spark catalog, for instance bucketed by document number."""

    def __init__(
        self,
        spark: SparkSession,
        database: str,
        server_key: str | None = None,
        on_missing: str = "error",
    ):
        super().__init__(spark, server_key, on_missing)
        self.database = database

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")


class JdbcSource(Source):
    """Tables of one site's database.

    ``options`` are those of Spark's JDBC reader (url, driver, user, password, ...).
    ``split`` gives per table the numeric or date column to read in parallel ranges:
    ``{"t_penjualan": {"partitionColumn": ..., "lowerBound": ..., "upperBound": ...,
    "numPartitions": ...}}``. The date and item filters of a product are pushed into the
    statement the database runs.
    """

    def __init__(
        self,
        spark: SparkSession,
        options: dict[str, str],
        server_key: str,
        split: dict[str, dict[str, str]] | None = None,
        schema: str | None = None,
        on_missing: str = "error",
    ):
        super().__init__(spark, server_key, on_missing)
        self.options = {"fetchsize": "10000", **options}
        self.split = split or {}
        self.schema = schema

    def reader_options(self, name: str) -> dict[str, str]:
        dbtable = f"{self.schema}.{name}" if self.schema else name
        return {**self.options, **self.split.get(name, {}), "dbtable": dbtable}

    def exists(self, name: str) -> bool:
        # The reader resolves the schema when the frame is made; an absent table fails there.
        return True

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.reader_options(name)).load()
