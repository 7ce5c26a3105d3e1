"""Connected components of an edge table by alternating large-star and small-star steps.

Each step shuffles its edges once, by vertex, and nothing is gathered per vertex: the few hubs with more links than a task's
part get their smallest neighbour from a map-side combined aggregate and their links are dealt over several tasks. The number
of edges, which says what a task's part is, is known from the round before, so no step is made twice to count it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, cut, shuffle_partitions


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Append `m`, the smallest v of each row's u. `total`: number of edges or more. A u with over `most` rows is a hub; such are
    fewer than four to a shuffle partition, which is what is broadcast, and their rows are dealt in parts of about `most`."""
    most = max(HOT, total // (4 * shuffle_partitions(edges.sparkSession)))
    hubs = edges.groupBy(F.col("u").alias("_hub")).agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    dealt = edges.join(F.broadcast(hubs), F.col("u") == F.col("_hub"), "left")
    part = F.when(F.col("_hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.ceil(F.col("_n") / most))).cast("int")
    least = F.min("v").over(Window.partitionBy("u", "_d"))
    return dealt.withColumn("_d", part).select("u", "v", F.coalesce("_m", least).alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex of its neighbourhood; as many edges, repeats included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them. Edges have u > v and may repeat."""
    # the row of the smallest neighbour becomes the vertex's own link
    return _with_least(edges, total).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex with an edge that isn't itself the smallest of its component.

    `edges`: columns u, v of one orderable type; direction, repeats and self-loops don't matter; rows with a null end
    are no edges; an empty table gives an empty result. Rounds grow with the logarithm of the component sizes.
    """
    e = edges.filter((F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = cut(e), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return e.select("u", F.col("v").alias("root"))
        before = state
        e = cut(_small_star(_large_star(e, state[0]), state[0]))
