"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import staged


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u. The minimum is combined map-side; a node
    with very many edges joins back as an ordinary skewed join."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges have u > v."""
    near = _with_least(edges)
    return near.select(
        F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        .alias("e")
    ).select("e.*").where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the least node reachable.

    Self links and null ends are ignored, repeated links count once, no links give no rows. Every
    step is a written table, so a lost executor repeats one step at most.
    """
    edges = staged(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        edges = staged(small_star(staged(large_star(edges), "large-star")), "small-star")
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
