"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the component's smallest node; roots are listed too.

    Alternates large-star and small-star steps: each hangs neighbours below the smallest one nearby, by minimum and
    equi-join, so no neighbourhood is collected. A star's centre, with more than its share of the edges, is joined by
    broadcast and not in one task. Every step is written out; the rounds grow with the logarithm of the component's
    size."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, "edges"), None

    def with_least(rows: DataFrame, near: DataFrame, total: int) -> DataFrame:
        """rows with m, the least b that near has for their a."""
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return join_counted(rows, least, ["a"], "n", total).drop("n")

    while True:
        n, digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, digest) == before or not n:
            break
        before = n, digest
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(now.select(F.col("b").alias("a"), F.col("a").alias("b")), both, 2 * n).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.distinct(), "edges")
        small = with_least(large, large, n)
        # a smallest neighbour hangs on itself here, where its own row is found
        hung = small.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        now = materialize(hung.where("a != b").distinct(), "edges")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
