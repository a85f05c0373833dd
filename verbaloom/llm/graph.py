"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach. Large-star and small-star rounds until nothing changes.

    Each round is two aggregations and two joins on the edges alone and ends in shared storage. A hub is split by Spark's skew
    join. Work is proportional to the edges; rounds grow with the logarithm of the longest chain.
    """
    links = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct(), "links")
    for _ in range(max_rounds):
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u != v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = cut(small, "links")
        # Done when each node hangs on one smaller node that itself hangs on none.
        twice = after.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("v").alias("x"))
        hanging = after.select(F.col("u").alias("x")).join(after.select(F.col("v").alias("x")), "x", "left_semi")
        release(links)
        links = after
        if twice.unionAll(hanging).isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
