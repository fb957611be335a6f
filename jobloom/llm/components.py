"""Connected components over an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u long, v long); root is the component's smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest
    neighbour (large star), then its smaller neighbours and itself (small star). Rounds grow with the logarithm
    of a component's size. Each round is written to the checkpoint folder, so a lost executor costs one
    round. Star centres may have any number of neighbours: minima are combined before the shuffle, and the join
    back is one that adaptive execution can split. Self loops, repeated edges and an empty table are fine
    (an empty table gives an empty result); null ends are ignored.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not now[0] or tuple(now) == before:
            break
        before = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
