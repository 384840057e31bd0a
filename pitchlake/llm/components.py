"""Connected components of a link table, by alternating star contraction.

Each round is a few aggregations and joins, so that neither links nor
components are ever gathered in one place. Contraction keeps every link's ends
connected and lets all of a component meet at its smallest node after a number
of rounds that grows with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import cut


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the smallest node that it reaches.

    Links of a node to itself and null ends are ignored; repeated links count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node go to its smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node go to its smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.filter("u != v").distinct())
        # done when every node has one link, to a root
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
