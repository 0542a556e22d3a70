"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every step is a
group-by minimum (pre-aggregated before its shuffle) and an equi-join (split by AQE where a
node is hot); nothing is collected per node and only two counters reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    b = _both(e)
    # stored before the join: both sides are then plain exchanges, and a hub's rows can be split
    low = materialize(b.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    return (b.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(d.groupBy("u").agg(F.min("v").alias("m")), "low")
    j = d.join(low, "u")
    return (j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(u, v)`` → ``(node, root)``: for each node of an edge the smallest node it reaches.

    Self loops, repeated edges and nulls are dropped; an empty table gives an empty table.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                    .distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        large = materialize(_large_star(e), "large")
        e = materialize(_small_star(large).where("u <> v").distinct(), "star")
        after = _state(e)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
