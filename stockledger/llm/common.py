"""What the corpus operators share: whole texts as bytes in small runs, and tables written once."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.session import shared_dir

RUN_BYTES = 1 << 20

_SCRATCH: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str], list[str]] = {}
_HELD: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder of this application in the shared folder; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark)}/corpus-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Best effort: a driver that has already lost its JVM leaves the folder to the cluster's own cleaning."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        return


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    _WRITTEN.setdefault((spark.sparkContext.applicationId, name), []).append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *names: str) -> None:
    """Remove what ``written`` has written under ``names``, once all that was made of it has been written too."""
    for name in names:
        for path in _WRITTEN.pop((spark.sparkContext.applicationId, name), []):
            _remove(spark, path)


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"{name}_{uuid.uuid4().hex}"


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def forget() -> None:
    """Let go of what a worker holds for the tasks of another stage."""
    stage = _stage()
    for key in [k for k in _HELD if k[0] != stage]:
        del _HELD[key]


def held(make: Callable, *given):
    """``make(*given)``, made once in a Python worker for all its tasks of one stage.

    Workers outlive stages, and what they hold counts against their executor; so the tasks of the next stage let go of it.
    """
    forget()
    key = (_stage(), make, *given)
    if key not in _HELD:
        _HELD[key] = make(*given)
    return _HELD[key]


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 texts (null: empty) of a column, about ``limit`` bytes at a time.

    A text is never cut: one longer than ``limit`` makes a run of its own.
    """
    forget()
    run, size = [], 0
    for text in column.cast(pa.binary()).fill_null(b""):
        text = text.as_py()
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def runs(batches: Iterator[pa.RecordBatch], limit: int = RUN_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the first two columns, in runs."""
    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for texts in text_runs(batch.column(1), limit):
            yield ids[at : at + len(texts)], texts
            at += len(texts)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


class Ids(dict):
    """Consecutive numbers of the values looked up, from ``start``."""

    def __init__(self, start: int = 0):
        super().__init__()
        self.start = start

    def __missing__(self, key):
        value = self[key] = len(self) + self.start
        return value


def offsets_of(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
