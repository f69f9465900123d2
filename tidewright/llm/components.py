"""Connected components of a table of edges, in DataFrame operations with staged rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage, staged, sweep


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b bigint); component: its smallest node.

    Alternates large-star and small-star rounds until the edges stop changing: about log2 of the
    longest path many. Each round is pre-aggregated and staged, and nothing but a count and a
    checksum comes to the driver. Loops and repeated edges are fine; no edges give no rows.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = staged()
    now = stage(both, "edges")
    mark = _mark(now)
    while mark[0]:
        # Large star: each node's larger neighbours move to its smallest neighbour.
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = stage(small, "edges")
        sweep(edges.sparkSession, first, [now])
        if (new := _mark(now)) == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
