"""Connected components over a table of links, by alternating large-star and small-star steps.

Each step is one aggregate and one join on the node; what is left after a round is written to the shared
folder, so a lost executor repeats one round at most; the round before is deleted. No link, node or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """edges (u > v). Large star (both): larger neighbours of u go to u's smallest; small star: u and its smaller ones do."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, label): label is the smallest node of the component. Unlinked nodes don't appear."""
    edges = materialize(links.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:
        old, edges = edges, materialize(_star(_star(edges, True), False))
        drop(old)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
