"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges go from the larger to the smaller node."""
    least = _least(edges)
    others = edges.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, one: str = "a", two: str = "b") -> DataFrame:
    """`u, v`: each linked node but the least of its component, with that least node."""
    edges = links.where(F.col(one) != F.col(two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct()
    edges = store(edges, "component-edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state.n:
            return edges
        seen = state
        edges = store(_small_star(_large_star(edges)), "component-edges")
