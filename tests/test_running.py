"""Running totals against a plain loop, with one group holding most of the rows."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockledger.operators import running
from stockledger.operators.running import Level, level_names, range_levels, running_totals, with_levels

GROUP = ["site", "item"]
SCHEMA = "site string, item string, a string, b int, seq int, qty decimal(18,4)"


def skewed(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        hot = rng.random() < 0.6
        out.append((
            rng.choice("st"),
            "hot" if hot else rng.choice("cdefg"),
            rng.choice(["", "x", "xy", "z"]),
            0 if rng.random() < 0.3 else rng.randint(-3, 3),
            seq,
            None if rng.random() < 0.05 else Decimal(rng.randint(-5000, 5000)) / 100,
        ))
    return out


def brute(data: list[tuple], key) -> dict[int, tuple]:
    groups = defaultdict(list)
    for row in data:
        groups[row[:2]].append(row)
    found = {}
    for members in groups.values():
        total = Decimal(0)
        for no, row in enumerate(sorted(members, key=key), 1):
            total += row[5] or 0
            found[row[4]] = (total, no)
    return found


def result(df) -> dict[int, tuple]:
    return {r.seq: (r.total, r.no) for r in df.collect()}


@pytest.mark.parametrize(
    ("levels", "key"),
    [
        ([("a", True)], lambda r: (r[2], r[4])),
        ([("a", True), ("b", True)], lambda r: (r[2], r[3], r[4])),
        ([("a", True), ("b", False), ("seq", True)], lambda r: (r[2], -r[3], r[4])),
        ([("b", False)], lambda r: (-r[3], r[4])),
    ],
)
def test_levels(spark, levels, key):
    data = skewed(700, seed=len(levels))
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = running_totals(
        df, GROUP, [Level(F.col(c), up) for c, up in levels], [F.col("seq").asc()],
        {"total": F.col("qty")}, ordinal="no",
    )
    assert found.columns == [*df.columns, "total", "no"]
    assert result(found) == brute(data, key)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("column", ["qty", "b", "a", "text", "moment"])
def test_ranges(spark, monkeypatch, column, ascending):
    """Any kind of value, ties and nulls, with chunks of a few rows each."""
    monkeypatch.setattr(running, "RANGES", 7)
    monkeypatch.setattr(running, "STRETCH", 4)
    data = skewed(900, seed=9)
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumns(
        {
            "text": F.concat(F.lit("no-"), F.when(F.col("seq") % 11 != 0, F.lpad(F.col("seq") % 300, 4, "0"))),
            "moment": F.expr("CASE WHEN seq % 7 <> 0 THEN timestamp_ntz '1969-12-30 23:59:00' + make_interval(0, 0, 0, seq % 90, 0, 0, seq % 3) END"),
        }
    )
    value = {r.seq: r[column] for r in df.collect()}
    levels = range_levels(df, F.col(column), ascending, F.col("seq"))
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    found = running_totals(df, GROUP, levels, [key, F.col("seq").asc()], {"total": F.col("qty")}, "no")
    ranks = {v: i for i, v in enumerate(sorted({v for v in value.values() if v is not None}, reverse=not ascending))}
    expected = brute(data, lambda r: (ranks.get(value[r[4]], len(ranks)), r[4]))
    assert result(found) == expected
    hot = with_levels(df, levels).where("item = 'hot'")
    assert hot.select(level_names(levels)[0]).distinct().count() > (2 if column in ("a", "b") else 5)


def test_the_only_window_is_over_chunks(spark):
    df = spark.createDataFrame(skewed(50, 1), SCHEMA)
    found = running_totals(
        df, GROUP, [Level(F.col("a")), Level(F.col("b"))], [F.col("seq").asc()],
        {"total": F.col("qty")}, ordinal="no",
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    raw = [line for line in plan.splitlines() if "windowspecdefinition" in line and "seq" in line]
    assert raw and all("__level0" in line and "__level1" in line for line in raw)
