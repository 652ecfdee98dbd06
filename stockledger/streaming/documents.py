"""Headers and lines of documents that both arrive as streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# State of waiting lines and headers: on the executors' disks with bounded memory instead of in their heaps, one store for each join.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # Counting would read before each write.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}

# Documents wait in packs: the rows of a batch whose documents share a bucket are one row of the state.
BUCKET, BUCKETS = "__bucket", 1 << 15
PACK_ROWS = 1 << 20  # Rows a task packs at a time, which bounds its memory.


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream started inside keeps its state as ``STATE_CONF`` says, unless the session names a state store itself."""
    provider = next(iter(STATE_CONF))
    if spark.conf.get(provider, None) is not None:
        yield
        return
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    try:
        for key, value in STATE_CONF.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def with_bucket(rows: DataFrame, number: str) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.hash(number), F.lit(BUCKETS)))


def packed(rows: DataFrame, site: Sequence[str], number: str, prefix: str) -> DataFrame:
    """Rows as one pack for each site and bucket of document numbers: an array of each column, in one order.

    A stream cannot be grouped without keeping state, so each task does it for the rows it has, ``PACK_ROWS`` or a little more at a time: a bucket
    may have several packs a batch.
    """
    inner = [c for c in rows.columns if c not in site]
    arrays = [T.StructField(f"{prefix}{c}", T.ArrayType(rows.schema[c].dataType)) for c in inner]
    schema = T.StructType([*[rows.schema[c] for c in site], T.StructField(BUCKET, T.IntegerType()), *arrays])

    def one_run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (run,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()  # Copied: not kept while the copy is dealt.
        group = run.column(BUCKET).to_numpy().astype(np.int64)
        for key in site:
            codes = run.column(key).dictionary_encode()
            group = group * len(codes.dictionary) + codes.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        group, run = group[order], run.take(pa.array(order))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        bounds = pa.array(np.append(starts, len(group)), pa.int32())
        firsts = run.select([*site, BUCKET]).take(pa.array(starts))
        lists = [pa.ListArray.from_arrays(bounds, run.column(c)) for c in inner]
        return pa.RecordBatch.from_arrays([*firsts.columns, *lists], names=schema.names)

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= PACK_ROWS:
                yield one_run(held)
                count = 0
        if held:
            yield one_run(held)

    return with_bucket(rows, number).mapInArrow(packs, schema)


def joined_streams(
    lines: DataFrame, heads: DataFrame, keys: Sequence[str], wait: str | None = None, carried: Iterable[str] | None = None
) -> DataFrame:
    """Lines with their header, whichever comes first; each line once.

    Both wait as state by the document's key, of which the last column is its number. A header that is sent again changes nothing. Without
    ``wait`` the state grows with all documents; it holds packs, as a row of its own for each line costs far more than the line. With
    it, an interval such as "30 days", a line or header is forgotten that long after it has come; what comes later than that is left for the
    next full refresh. Columns that are neither keys nor ``carried`` do not wait, and are null in the result.
    """
    columns = [*lines.columns, *[c for c in heads.columns if c not in lines.columns]]
    left_out = {}
    if carried is not None:
        kept = {*keys, *carried}
        left_out = {f.name: f.dataType for f in [*lines.schema, *heads.schema] if f.name not in kept}
        lines, heads = lines.drop(*left_out), heads.drop(*left_out)
    # State has a schema of its own, null or not: a batch without rows must not plan another one.
    present = {key: F.coalesce(key, F.lit("")) for key in keys}
    for key in keys:
        lines, heads = lines.where(F.col(key).isNotNull()), heads.where(F.col(key).isNotNull())
    lines, heads = lines.withColumns(present), heads.withColumns(present)
    joined = _within(lines, heads, keys, wait) if wait else _for_good(lines, heads, keys)
    return joined.select(*[F.lit(None).cast(left_out[c]).alias(c) if c in left_out else c for c in columns])


def _for_good(lines: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packs meet by bucket, then each line of a pack finds its header by the document's number: a number stands once among all headers.

    Headers, the fewer, are dealt by bucket before they are packed, so that the waiting lines of a bucket are read once a batch.
    """
    *site, number = keys
    dealt = with_bucket(heads.dropDuplicates(list(keys)), number).repartition(*site, BUCKET).drop(BUCKET)
    pairs = packed(lines, site, number, "__detail_").join(packed(dealt, site, number, "__head_"), [*site, BUCKET])
    each = pairs.select("*", F.posexplode(f"__detail_{number}").alias("__at", number))
    place = F.array_position(f"__head_{number}", F.col(number))
    head_at = (place - 1).cast("int")
    return each.where(place > 0).select(
        *keys,
        *[F.get(f"__detail_{c}", F.col("__at")).alias(c) for c in lines.columns if c not in keys],
        *[F.get(f"__head_{c}", head_at).alias(c) for c in heads.columns if c not in keys],
    )


def _within(lines: DataFrame, heads: DataFrame, keys: Sequence[str], wait: str) -> DataFrame:
    own = {key: f"__head_{key}" for key in keys}
    heads = heads.withColumn("__head_at", F.current_timestamp()).withWatermark("__head_at", "0 seconds")
    heads = heads.dropDuplicatesWithinWatermark(list(keys)).withColumnsRenamed(own)
    lines = lines.withColumn("__line_at", F.current_timestamp()).withWatermark("__line_at", "0 seconds")
    near = F.expr(f"__line_at BETWEEN __head_at - INTERVAL {wait} AND __head_at + INTERVAL {wait}")
    for key, head in own.items():
        near = near & (F.col(key) == F.col(head))
    return lines.join(heads, near).drop(*own.values(), "__head_at", "__line_at")
