"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the least of these. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component, the smallest id that it reaches, for each id of an edge.

    Only minima per node are aggregated and joined back, so a node with any
    number of neighbours costs a row per task and edge, and no list of
    neighbours is built. Every round is written to the shared folder; rounds end
    when the edges stay as they were, which takes their count and a sum of hashes.
    Loops and repeated edges are dropped; edges with a null end are, too. No
    edges give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(high.cast("long").alias("u"), low.cast("long").alias("v")).distinct(), "edges")
    state = None
    while True:
        after = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        now = after
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
