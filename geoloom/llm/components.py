"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id of the links (a, b): component is the smallest id it is linked to, at whatever remove.

    Rounds of large star and small star: each node's larger neighbours, then
    its smaller ones, are linked to the smallest node around it, until the links
    are stars. The minimum around a node is pre-aggregated, and a node of many
    neighbours meets its minimum in a join that can be split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u > v").distinct(), "links")
        exact = "decimal(38,0)"
        state = edges.agg(F.count("*"), F.sum(F.col("v").cast(exact)), F.sum(F.xxhash64("u", "v").cast(exact)))
        now = tuple(state.first())
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
