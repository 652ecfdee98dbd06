"""A stream reads the line table the same way as one file and as a folder of part files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledger_checks import queries

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.is_dir(), reason="needs the test tables")
def test_lines_in_one_file_or_in_many(spark, tmp_path):
    for file in SMALL.glob("*.parquet"):
        if file.name != "lineitem.parquet":
            (tmp_path / file.name).symlink_to(file)
    lines = spark.read.parquet(str(SMALL / "lineitem.parquet"))
    lines.repartition(3, F.col("l_orderkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = [queries.delta_stream(spark, str(d)).orderBy("kd_divisi", "kd_barang").collect() for d in (SMALL, tmp_path)]
    assert found[0] and found[0] == found[1]
