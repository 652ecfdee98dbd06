"""Connected components of links that may be many, by alternating stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import written


ROWS = 100_000  # edges of a written part at least, as long as there are so many


def _gathered(edges: DataFrame, rows: int) -> DataFrame:
    """In fewer parts where ``rows`` edges do not fill them; a part of a few edges costs a task and a file in every round."""
    return edges.coalesce(max(1, -(-rows // ROWS)))


def _mark(edges: DataFrame) -> tuple:
    """Number and hash of the edges, to see whether a round changed them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of a link that is not its own component.

    Each round joins every node's larger neighbours to its smallest one, then its smaller neighbours. Minima are summed up
    before each shuffle, and the joins are plain ones on a node, which Spark splits where a node has very many links. Links of a
    node with itself or with null say nothing.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(edges.select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(_gathered(large, mark[0]), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(_gathered(small, mark[0]), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
