"""Waiting lines and headers are packs, a few rows of the state for many documents."""

import json

from pyspark.sql import functions as F

from stockledger.streaming import documents

KEYS = ["server_key", "no"]
LINES = "server_key string, no string, item string, qty decimal(18,4), price int"
HEADS = "server_key string, no string, day timestamp_ntz, price_list string"
DAY = "timestamp_ntz'2024-02-20 10:00:00'"


def test_few_rows_of_state_for_many_documents_and_each_line_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "BUCKETS", 8, raising=False)
    monkeypatch.setattr(documents, "PACK_ROWS", 150, raising=False)
    # Numbers stand for other documents at other sites; some lines have no header, no number or no site, some headers no lines.
    site = "CASE id % 10 WHEN 9 THEN NULL WHEN 8 THEN '' ELSE concat('s', id % 2) END"
    line = [f"{site} AS server_key", "CASE WHEN id % 61 <> 0 THEN cast(id % 300 AS string) END AS no"]
    lines = spark.range(1200).selectExpr(
        *line, "CASE WHEN id % 7 <> 0 THEN concat('i', id) END AS item", "CASE WHEN id % 5 <> 0 THEN cast(id AS decimal(18,4)) / 8 END AS qty", "id AS price"
    ).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LINES.split(", ")])
    heads = spark.range(100, 400).selectExpr("explode(array('s0', 's1', '')) AS server_key", "cast(id AS string) AS no", f"{DAY} + make_dt_interval(id) AS day", "'x' AS price_list")
    for folder in ("lines", "heads"):
        (tmp_path / folder).mkdir()

    def stream(name, ddl):
        return spark.readStream.schema(ddl).parquet(str(tmp_path / name))

    found, updated = [], []

    def batch(new_lines=None, new_heads=None):
        for name, rows in (("lines", new_lines), ("heads", new_heads)):
            if rows is not None:
                rows.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        rows = documents.joined_streams(stream("lines", LINES), stream("heads", HEADS), KEYS, None, ["item", "qty", "day"])
        with documents.state_on_disk(spark):
            run = rows.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        states = json.loads(run.lastProgress.json)["stateOperators"]
        updated.append(sum(s["numRowsUpdated"] for s in states if s["operatorName"] == "symmetricHashJoin"))

    early, late = lines.where("price % 4 <> 0"), lines.where("price % 4 = 0")
    batch(early)
    assert not found
    # Three sites of 8 buckets in runs of 150 rows or a little more; without packs, a row for each of the hundreds of lines.
    assert 0 < updated[0] <= 3 * 8 * (early.count() // 150 + 1) < early.count()
    batch(None, heads.where("no < '250'"))
    batch(late, heads.where("no < '300'"))  # some of them sent again
    batch(None, heads)
    expected = lines.drop("price").join(heads.drop("price_list"), KEYS).select(*KEYS, "item", "qty", "day")
    assert found and sorted(map(str, [r[:3] + r[3:4] + r[5:6] for r in found])) == sorted(str(tuple(r)) for r in expected.collect())
    assert all(r.price is None and r.price_list is None for r in found)
