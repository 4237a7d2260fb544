"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import written


def _minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u. The minimum is aggregated before
    it is shuffled, so that a node with very many edges is no group of its own."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges(u, v), two bigint columns without nulls; component is the least node.

    Each round writes its edges to the shared folder. The number of rounds grows
    with the logarithm of a component's size.
    """
    pair = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = written(pair.distinct(), "edges")
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _minimum(both)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        seen = _minimum(large)
        small = (
            seen.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(seen.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = written(small, "edges")
        now = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        ).first()
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
