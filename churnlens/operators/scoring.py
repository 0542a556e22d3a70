"""Scoring: probability → risk band → decision, plus the scoring summaries.

A score is any ``churn_probability`` column: the fixed-weight fixture score
(checkable by SQL without a fitted model) or a fitted MLlib model
(:func:`score_with_model`).  Scoring is a narrow projection (no shuffle); the
summaries are single partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import decision, risk_band
from ..functions.expressions import model_input_sql
from .ranking import exact_median
from .segments import attach_scalar, _stack

PROBABILITY = "churn_probability"


def linear_margin(weights: dict[str, float], intercept: float) -> Column:
    """w·x + b over guarded model inputs, summed in the weights' order."""
    terms = [f"(CAST({float(w)!r} AS DOUBLE) * ({model_input_sql(f)}))" for f, w in weights.items()]
    return F.expr(" + ".join(terms) + f" + CAST({float(intercept)!r} AS DOUBLE)")


def fixture_probability(weights: dict[str, float] = S.FIXTURE_WEIGHTS,
                        intercept: float = S.FIXTURE_INTERCEPT, digits: int = 6) -> Column:
    """σ(w·x + b) rounded to 6 digits — the deterministic fixture score."""
    z = linear_margin(weights, intercept)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), digits)


def add_bands(scored: DataFrame, threshold=S.DEFAULT_THRESHOLD, p: str = PROBABILITY) -> DataFrame:
    """PR6 + PR7 — risk band and hard decision.  ``threshold`` may be a float or a
    one-row DataFrame with a ``threshold`` column (e.g. tuned on validation)."""
    if isinstance(threshold, DataFrame):
        scored = attach_scalar(scored, threshold.select(F.col("threshold").alias("_threshold")))
        t = F.col("_threshold")
    else:
        t = F.lit(float(threshold))
    out = scored.withColumn("risk_level", risk_band(p)).withColumn("predicted_churn", decision(p, t))
    return out.drop("_threshold") if isinstance(threshold, DataFrame) else out


def score_fixture(features: DataFrame, threshold=S.DEFAULT_THRESHOLD) -> DataFrame:
    """Feature table + fixture probability, band and decision (SC3 over a fixed score)."""
    return add_bands(features.withColumn(PROBABILITY, fixture_probability()), threshold)


def risk_band_counts(scored: DataFrame, p: str = PROBABILITY) -> DataFrame:
    """AG17 — High / Medium / Low counts and percents; absent bands are 0."""
    band = risk_band(p)
    one = scored.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(band == "High").alias("h"),
                     F.count_if(band == "Medium").alias("m"),
                     F.count_if(band == "Low").alias("l"))
    pct = {k: F.when(F.col("n") > 0, F.col(k) / F.col("n") * 100).otherwise(F.lit(0.0)) for k in "hml"}
    one = one.select("h", "m", "l", pct["h"].alias("hp"), pct["m"].alias("mp"), pct["l"].alias("lp"))
    return one.select(_stack([("High", ["h", "hp"]), ("Medium", ["m", "mp"]), ("Low", ["l", "lp"])],
                             ["risk_level", "customers", "pct"]))


def scoring_summary(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                    p: str = PROBABILITY) -> DataFrame:
    """IO14 / AG18 — one row: counts and percents per band, mean and exact median
    probability, threshold used."""
    band = risk_band(p)
    agg = scored.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(band == "High").alias("high"),
                     F.count_if(band == "Medium").alias("medium"),
                     F.count_if(band == "Low").alias("low"),
                     F.avg(p).alias("mean_probability"))
    agg = attach_scalar(agg, exact_median(scored, p).withColumnRenamed("median", "median_probability"))
    pct = {k: F.when(F.col("total") > 0, F.col(k) / F.col("total") * 100) for k in ("high", "medium", "low")}
    return agg.select("total", "high", "medium", "low",
                      pct["high"].alias("high_pct"), pct["medium"].alias("medium_pct"),
                      pct["low"].alias("low_pct"), "mean_probability", "median_probability",
                      F.lit(float(threshold)).alias("threshold"))


def high_risk_list(scored: DataFrame, threshold: float = S.RISK_HIGH, p: str = PROBABILITY,
                   key: str = "loyalty_number") -> DataFrame:
    """SO5 — probability ≥ threshold, highest first (key breaks ties)."""
    return (scored.where(F.col(p) >= threshold)
            .select(key, p, "risk_level")
            .orderBy(F.desc(p), F.asc(key)))


def top_risk(scored: DataFrame, k: int = 20, p: str = PROBABILITY, key: str = "loyalty_number",
             extra: tuple[str, ...] = ("loyalty_card", "clv", "top_risk_factor")) -> DataFrame:
    """SO3 — the k riskiest customers with optional tier / CLV / top factor columns."""
    cols = [key] + [c for c in extra if c in scored.columns] + [p, "risk_level"]
    return scored.orderBy(F.desc(p), F.asc(key)).limit(k).select(*cols)
