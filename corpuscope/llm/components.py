"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscope.session import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    """Per vertex u of ``edges`` (u, v) the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of ``edges`` (a, b, comparable ids without NULLs).

    ``component`` is the smallest vertex that can be reached. Every round links the neighbours of each vertex to their
    smallest one; rounds grow with the logarithm of the longest path, not with the number of edges. Each round's
    edges are a table in the shared folder. Loops and repeated edges do no harm; no edges give no rows.
    """

    def tidy(found: DataFrame) -> DataFrame:
        return materialise(found.where("u <> v").distinct(), "stars")

    def state(found: DataFrame):
        return found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    before, after = None, state(now)
    while before != after:
        now = tidy(_small_star(_large_star(now)))
        before, after = after, state(now)
    # At rest every edge points from a vertex to its component's smallest one.
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots).distinct()
