"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqscan.plans.spool import spool


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for all nodes of `edges`; root is the least node that can be reached.

    Alternating large-star and small-star rounds. Each round is two aggregations and two joins,
    written to the shared folder; rounds grow with the logarithm of the longest path. A hub's edges
    are joined with a single row, which a skewed join splits.
    """
    x, y = F.col(a), F.col(b)
    now = spool(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = spool(small, "edges")
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for d in (now, new)]
        now = new
        if sums[0] == sums[1]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
