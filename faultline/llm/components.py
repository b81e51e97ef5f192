"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join; the table is written after each pair of steps, and the
driver learns two numbers about it. A pair of steps returns one link for each node but the smallest,
and one for each link that does not yet end at a smallest node, so the table never grows past both. No task sees a whole component: a hub's links are joined with
its smallest neighbour, and Spark may split such a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import numbers


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each linked node can reach, itself included.

    Links may be repeated, in either direction, or from a node to itself; those with null are left out.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    edges = numbers(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(low, high).where("low < high").distinct(), "edges")
    state = None
    while True:
        # large star: the larger end of each link goes to the smallest neighbour of the other end
        ends = edges.select(F.col("low").alias("node"), F.col("low").alias("near")).unionByName(
            edges.select(F.col("high").alias("node"), F.col("low").alias("near")))
        large = edges.join(ends.groupBy(F.col("node").alias("low")).agg(F.min("near").alias("to")), "low").select(
            "high", F.col("to").alias("low"))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("to"))
        small = large.join(least, "high").select(F.col("to").alias("low"), F.col("low").alias("high"))
        edges = numbers(small.where("low < high").unionByName(least.select(F.col("to").alias("low"), "high")), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
