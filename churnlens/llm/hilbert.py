"""Sharding by Hilbert-curve order, with DataFrame operations only.

Several metadata columns are quantised at their own quantiles, the cells are numbered along a Hilbert
curve (Skilling, "Programming the Hilbert curve", 2004), rows are put in curve order by one range
shuffle, and the order is cut into runs.  Neighbouring cells land in the same shard, so the minima and
maxima of every one of the columns prune shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import global_rank


#: Distinct strings in order whose rows one task counts up.
RUN = 65_536


def _string_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """The least strings at or below which lie 1, 2, ... ``cells``-ths of the rows that are not null.

    Distinct values are counted, put in order by their whole length, and their counts added up in runs
    of values; only the cuts reach the driver.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ranked = global_rank(counts, ["v"]).withColumn("part", F.expr(f"rank div {RUN}"))
    sums = ranked.groupBy("part").agg(F.sum("n").alias("s"))
    offsets = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"),
                          F.sum("s").over(Window.partitionBy()).alias("rows"))
    upto = ranked.join(F.broadcast(offsets), "part").withColumn(
        "upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("rank")))
    passed = lambda at: F.least(F.expr(f"({at}) * {cells} div rows"), F.lit(cells - 1))
    return sorted((r["v"] for r in upto.where(passed("upto") > passed("upto - n")).select("v").collect()), key=str.encode)


def quantise(df: DataFrame, dims: list[str], bits: int, accuracy: int = 10_000) -> DataFrame:
    """Adds ``x0..``: for each dimension the number of its quantile cuts at or below the value.

    The cuts of numbers come from one aggregate over all rows, those of strings from the counts of whole
    values; nulls and NaN go to cell 0.
    """
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    text = [isinstance(df.schema[d].dataType, T.StringType) for d in dims]
    cuts = {i: _string_cuts(df, d, 1 << bits) for i, d in enumerate(dims) if text[i]}
    df = df.withColumns({f"__o{i}": F.col(d) if text[i] else F.col(d).cast("double") for i, d in enumerate(dims)})
    numbers = [i for i in range(len(dims)) if not text[i]]
    if numbers:
        found = df.agg(*[F.percentile_approx(F.when(~F.isnan(f"__o{i}"), F.col(f"__o{i}")), share, accuracy).alias(f"c{i}")
                         for i in numbers]).first()
        cuts |= {i: sorted({float(c) for c in found[f"c{i}"] or []}) for i in numbers}
    def cell(i: int) -> Column:
        at = F.array(*map(F.lit, cuts[i])) if cuts[i] else F.array().cast("array<string>" if text[i] else "array<double>")
        below = F.size(F.filter(at, lambda c: c <= F.col(f"__o{i}")))
        none = F.col(f"__o{i}").isNull()
        return F.when(none if text[i] else none | F.isnan(f"__o{i}"), 0).otherwise(below).cast("int")
    return df.withColumns({f"x{i}": cell(i) for i in range(len(dims))}).drop(*[f"__o{i}" for i in range(len(dims))])


def hilbert_index(df: DataFrame, n: int, bits: int) -> DataFrame:
    """Adds ``curve``, the Hilbert index of the cell in columns ``x0..x{n-1}``, and drops those columns.

    Each step is a projection on the columns of the step before.
    """
    x = [f"x{i}" for i in range(n)]
    col = F.col
    for level in range(bits - 1, 0, -1):
        side, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = col(x[i]).bitwiseAND(side) != 0
            swap = col(x[0]).bitwiseXOR(col(x[i])).bitwiseAND(F.lit(low))
            if i == 0:
                df = df.withColumn(x[0], F.when(high, col(x[0]).bitwiseXOR(F.lit(low))).otherwise(col(x[0])))
            else:
                df = df.withColumns({
                    x[0]: F.when(high, col(x[0]).bitwiseXOR(F.lit(low))).otherwise(col(x[0]).bitwiseXOR(swap)),
                    x[i]: F.when(high, col(x[i])).otherwise(col(x[i]).bitwiseXOR(swap))})
    for i in range(1, n):
        df = df.withColumn(x[i], col(x[i]).bitwiseXOR(col(x[i - 1])))
    flip = F.lit(0)
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(col(x[n - 1]).bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0))
    df = df.withColumn("__flip", flip)
    df = df.withColumns({c: col(c).bitwiseXOR(col("__flip")) for c in x})
    curve = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for c in x:
            curve = curve * 2 + F.shiftright(col(c), bit).bitwiseAND(1)
    return df.withColumn("curve", curve).drop("__flip", *x)


def assign_shards(rows: DataFrame, dims: list[str], n_shards: int, ties: list[str], bits: int = 5) -> DataFrame:
    """``rows`` plus ``curve``, ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in a shard).

    Law of rows: shard sizes differ by one at most.  Rows of one cell follow ``ties``; wholly equal rows
    are interchangeable.  With fewer rows than shards the last shards stay empty; an empty table gives
    an empty table.  Null dimensions sort into cell 0.  All columns of ``rows`` are kept, but for those named
    ``curve``, ``shard`` or ``slot``, whose place the new ones take.
    """
    own = {c: f"__own{i}" for i, c in enumerate(rows.columns)}
    cells = hilbert_index(quantise(rows.withColumnsRenamed(own), [own[d] for d in dims], bits), len(dims), bits)
    r = global_rank(cells, ["curve", *(own[t] for t in ties)])
    shard = F.expr(f"(rank * {n_shards}) div total")
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return (r.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
            .select(*[F.col(o).alias(c) for c, o in own.items() if c not in ("curve", "shard", "slot")],
                    "curve", F.col("shard").cast("int").alias("shard"), "slot"))


def zone_map(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, and the least and greatest value of each dimension, by shard: what prunes files."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"),
                                        *[f(d).alias(f"{d}_{n}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, rows in slot order."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
