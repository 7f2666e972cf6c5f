"""Connected components of a large graph by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countercheck.llm.support import owned, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links lead to.

    ``edges`` has two columns of the same ordered type; direction, repeats and
    loops don't matter, rows with a null are no link. Only nodes with an edge
    come out. No edges: no rows.

    Each round points every larger neighbour of a node to the smallest one
    (large star), then every node's smaller neighbours likewise (small star).
    Edges never get more, and the number of rounds grows with the logarithm of
    the longest path. The number of edges, known from the round before, says how
    many files a table needs. A round's minima are stored before the join, so that a
    node with very many edges is split between tasks. Of all tables that are
    stored, only the result is left.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    low = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    spark = edges.sparkSession
    with owned(spark) as scope:
        now = stored(low.filter("node <> root and root is not null").distinct(), "edges")
        mark = _mark(now)
        while True:
            with owned(spark) as round_:
                both = now.unionAll(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
                large = _star(both, 2 * mark[0]).filter("root0 > node").selectExpr("root0 as node", "least(least0, node) as root")
                large = stored(large.filter("node <> root").distinct(), "large-star", rows=mark[0])
                small = _star(large, mark[0])
                new = small.selectExpr("root0 as node", "least0 as root").unionAll(
                    small.selectExpr("node", "least0 as root")
                )
                new = stored(new.filter("node <> root").distinct(), "small-star", rows=mark[0])
                round_.keep(new)
            scope.drop(now)
            before, mark = mark, _mark(new)
            if mark == before:
                scope.keep(new)
                return new
            now = new


def _star(edges: DataFrame, rows: int) -> DataFrame:
    """Each edge (node, root0) with the smallest neighbour of the node. ``rows``: so many edges at most."""
    least = stored(edges.groupBy("node").agg(F.min("root").alias("least0")), "least", rows=rows)
    return edges.withColumnRenamed("root", "root0").join(least, "node")


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges; equal sets have equal marks."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")),
        F.sum(F.xxhash64("root", "node").cast("decimal(38,0)")),
    ).first()
    return tuple(row)
