"""What a stored snapshot is made of is computed once."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from stockledger import schemas
from stockledger.sinks.snapshot_store import SnapshotStore


def test_publishing_computes_the_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def key(number):
        made.add(1)
        return str(number)

    rows = spark.range(0, 500, 1, 4).withColumn("kd_barang", F.udf(key, "string")("id"))
    fixed = {c: F.lit("x" if t == "string" else 1).cast(t) for c, t in schemas.SNAPSHOT.items() if c != "kd_barang"}
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(rows.withColumns(fixed), "2024-01-01", "2024-01-01 00:00:00", None, ["x"])
    assert made.value == 500
    assert store.read("x").select("kd_barang").distinct().count() == 500
    # Only the published folder is left.
    assert len(list((tmp_path / "data").iterdir())) == 1


def test_rows_of_one_site_are_written_once_and_by_item_in_each_file(spark, tmp_path, monkeypatch):
    written, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), plain(self, path, *a, **k)))
    fixed = {c: F.lit("x" if t == "string" else 1).cast(t) for c, t in schemas.SNAPSHOT.items() if c != "kd_barang"}
    rows = spark.range(0, 500, 1, 4).withColumn("kd_barang", F.reverse(F.col("id").cast("string"))).withColumns(fixed)
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(rows, "2024-01-01", "2024-01-01 00:00:00", None, ["x"])
    assert len(written) == 1
    files = sorted((tmp_path / "data").rglob("*.parquet"))
    found = [[r.kd_barang for r in spark.read.parquet(str(f)).select("kd_barang").collect()] for f in files]
    assert sum(map(len, found)) == 500 and all(keys == sorted(keys) for keys in found)
