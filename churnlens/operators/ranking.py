"""Global order statistics without a single-task window.

``Window.orderBy(x)`` with no partition moves every row into one task.  Running totals are a prefix scan here:

1. one range shuffle puts the rows in order, partition after partition;
2. each partition adds up its own rows as they pass and is written once, with its number;
3. the partitions' totals, a table as long as there are partitions, become offsets;
4. a row's total is its own partition's running sum plus the partition's offset.

With ``by`` the scan starts anew in each group; groups may span partitions and partitions hold
many groups, so neither a large nor a small group is a task of its own.

The rows are counted first: up to ``ONE_TASK`` of them, as most tables of distinct scores are, are one window.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that one task may hold in order.
ONE_TASK = 100_000


def _scan_batches(batches, by: list[int], sums: list[int]):
    """Running sums of whole-number columns over the partition's rows, anew in each group."""
    last, carry = None, [0] * len(sums)
    for b in batches:
        if not b.num_rows:
            continue
        groups = list(zip(*(b.column(i).to_pylist() for i in by))) if by else [()] * b.num_rows
        first = np.array([i for i, g in enumerate(groups) if i == 0 or g != groups[i - 1]])
        carry = carry if groups[0] == last else [0] * len(sums)
        out = []
        for j, i in enumerate(sums):
            total = np.cumsum(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[0], total])[first]                 # what earlier groups of the batch added
            before[0] -= carry[j]
            total -= np.repeat(before, np.diff(np.append(first, b.num_rows)))
            carry[j] = int(total[-1])
            out.append(pa.array(total))
        last = groups[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *(f"_sum{j}" for j in range(len(sums)))])


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                   buckets: int | None = None, prefix: str = "cum_", then: list[str] = [], by: list[str] = []) -> DataFrame:
    """Add ``cum_<c>`` = Σ c over rows whose order value is ≤ (≥ if descending) this row's, within ``by``.

    The summed columns hold whole numbers.  ``df`` should hold one row per distinct ``order_col`` value (aggregate
    first), or name columns ``then`` that order rows of equal values.  ``buckets`` is the number of range partitions.
    """
    from ..session import ensure_checkpoint_dir, ship_package
    spark = df.sparkSession
    if df.limit(ONE_TASK + 1).count() <= ONE_TASK:
        w = (Window.partitionBy(*by).orderBy(F.col(order_col).desc() if descending else F.col(order_col).asc(), *then)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("*", *[F.sum(F.col(c).cast("long")).over(w).alias(f"{prefix}{c}") for c in sum_cols])
    ship_package(spark)
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    order = [*by, F.col(order_col).desc() if descending else F.col(order_col).asc(), *then]
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    own = [f"_sum{j}" for j in range(len(sum_cols))]
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in own)])
    names = ranged.columns
    scanned = ranged.mapInArrow(partial(_scan_batches, by=[names.index(c) for c in by], sums=[names.index(c) for c in sum_cols]), schema)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-scan/{uuid.uuid4().hex}"
    scanned.write.parquet(path)
    scanned = spark.read.schema(schema).parquet(path)
    totals = scanned.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t{j}") for j, c in enumerate(sum_cols)])
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition, and one more for each further group that a partition holds
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t{j}").over(w), F.lit(0)).alias(f"_o{j}") for j in range(len(sum_cols))])
    offsets = offsets.withColumnsRenamed({"_part": "_p", **{c: f"_b{i}" for i, c in enumerate(by)}})
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = scanned.join(F.broadcast(offsets) if not by else offsets, same)
    return out.select(*df.columns, *[(F.col(own[j]) + F.col(f"_o{j}")).alias(f"{prefix}{c}") for j, c in enumerate(sum_cols)])


def percent_ranks(df: DataFrame, value: str, by: list[str], name: str = "percent_rank", digits: int = 9) -> DataFrame:
    """``df`` plus the percent rank of ``value`` within ``by``: rows with a smaller value over all other rows.

    Values are compared at ``digits`` decimals; equal ones share a rank, a group of one row has rank 0, and a
    null value has none and doesn't count.
    """
    at = df.withColumn("_v", F.round(value, digits))
    per = at.where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    ranks = running_totals(per, "_v", ["_n"], by=by)
    own = {c: f"_b{i}" for i, c in enumerate(by)}
    whole = ranks.groupBy(*by).agg(F.sum("_n").alias("_all")).withColumnsRenamed(own)
    same = F.lit(True)
    for c, other in own.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    place = ((F.col("cum__n") - F.col("_n")) / F.greatest(F.col("_all") - 1, F.lit(1))).alias(name)
    placed = ranks.join(whole, same).select(*[F.col(c).alias(o) for c, o in own.items()], F.col("_v").alias("_w"), place)
    return at.join(placed, same & (F.col("_v") == F.col("_w")), "left").select(*df.columns, name)


#: Cells that a round of refinement counts.
CELLS = 4096


def order_statistics(df: DataFrame, value: str, ranks) -> list[float]:
    """The values at some ranks (from 1; ``ranks`` is a function of the number of values), nulls left out.

    No value is moved: each round counts the values of at most one range per rank in ``CELLS`` equal cells, with
    the cells' least and greatest value, and goes on inside the cell that holds the rank, until that is one value.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    asked = ranks(n) if n else []
    at = {r: (low, high, 0) for r in asked}                              # least, greatest, values below
    while any(a < b for a, b, _ in at.values()):
        spans = sorted({(a, b) for a, b, _ in at.values() if a < b})
        cell = F.lit(None).cast("int")
        for i, (a, b) in enumerate(spans):
            inside = (F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b))
            # halves, so that the width of a range can't overflow
            part = (F.col("v") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2)
            cell = F.when(inside, F.least((part * CELLS).cast("int"), F.lit(CELLS - 1)) + i * CELLS).otherwise(cell)
        counted = (v.select("v", cell.alias("c")).where(F.col("c").isNotNull()).groupBy("c")
                   .agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect())     # at most CELLS a range
        for r, (a, b, below) in at.items():
            if a < b:
                first = spans.index((a, b)) * CELLS
                for c in sorted((c for c in counted if first <= c["c"] < first + CELLS), key=lambda c: c["c"]):
                    if below + c["n"] >= r:
                        at[r] = (c["a"], c["b"], below)
                        break
                    below += c["n"]
    return [at[r][0] for r in asked]


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """Exact median (mean of the two middle values for an even count), one row; null without values."""
    found = order_statistics(df, value, lambda n: sorted({(n + 1) // 2, n // 2 + 1}))
    median = (found[0] + found[-1]) / 2 if found else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"))
