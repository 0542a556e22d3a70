"""The position of every row in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def global_rank(df: DataFrame, order: list) -> DataFrame:
    """``df`` plus ``rank`` (from 0 in ``order``) and ``total``, the number of rows.

    One range shuffle sorts the rows; each keeps its partition and place there.  The rows per
    partition, a table as long as there are partitions, become the offsets.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = materialize(placed, "ranked").withColumn("__part", F.shiftright("__at", 33))
    w = Window.orderBy("__part")
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = parts.select("__part", (F.sum("n").over(w) - F.col("n")).alias("__before"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn("rank", F.col("__before") + place).drop("__at", "__part", "__before"))
