"""Mergeable quantile sketches (AG15, AG16, AG18 at scale).

A stored table has one KLL sketch of a value per segment; any selection of segments is answered by merging
its rows, without the data.  Building is one partial aggregate, merging reads as many rows as there are segments.
``k`` bounds a sketch's size and its rank error (about 1.7 / k**0.9; 800 gives well below 1 % of the ranks).  The exact
median of ``ranking.exact_median`` stays the default of the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import attach_scalar

K = 800


def sketch(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """``by``, ``sketch`` (binary) and ``n`` values: one row per segment; null values don't count."""
    return (df.where(F.col(value).isNotNull()).groupBy(*by)
            .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count("*").alias("n")))


def merge(sketches: DataFrame, by: list[str] = []) -> DataFrame:
    """One sketch per group of stored segments (one of all without ``by``)."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """The sketches' rows without the binary, one row for each probability: ``probability, quantile``."""
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("probability"),
                               F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probabilities])
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, F.explode(pairs).alias("_q")).select(*rest, "_q.probability", "_q.quantile")


def rank_errors(df: DataFrame, value: str, estimates: DataFrame, by: list[str]) -> DataFrame:
    """How far each estimate lies from its probability, in shares of the group's ranks: 0 where its equal values span it."""
    own = {c: f"_b{i}" for i, c in enumerate(by)}
    est = estimates.withColumnsRenamed(own)
    same = F.lit(True)
    for c, other in own.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    # a few estimates for each group: as many rows as segments
    met = (df.where(F.col(value).isNotNull()).join(F.broadcast(est), same) if by else
           attach_scalar(df.where(F.col(value).isNotNull()), est.agg(F.collect_list(F.struct("probability", "quantile")).alias("_e")))
           .select(value, F.explode("_e").alias("_x")).select(value, "_x.probability", "_x.quantile"))
    v = F.col(value).cast("double")
    per = met.groupBy(*own.values(), "probability").agg(
        F.avg((v < F.col("quantile")).cast("double")).alias("_below"), F.avg((v <= F.col("quantile")).cast("double")).alias("_upto"))
    off = F.greatest(F.col("_below") - F.col("probability"), F.col("probability") - F.col("_upto"), F.lit(0.0))
    return per.select(*[F.col(o).alias(c) for c, o in own.items()], "probability", off.alias("rank_error"))
