"""Connected components of a link table by alternating star contractions, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import scoped, table


@scoped
def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any orderable type. Returns (node, root), root being the least node of its component.

    Each round points every neighbour at a node's least neighbour; the rounds grow with the logarithm of the
    longest path, not with its length. Rows stay in proportion to the links: no neighbour list is gathered.
    """
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
