"""Customer feature table: one aggregate over activity, one join, one projection.

The original computes the flight features with six group-bys over the same
activity table merged back on the key.  Here they are fused into a single
``groupBy(key).agg(...)`` of conditional aggregates (one shuffle, partial
aggregation on the map side), then joined 1:1 with the encoded loyalty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import null_safe_flag
from ..functions.expressions import model_input_sql


def _case_map(col: str, mapping: dict, dtype: str = "DOUBLE") -> str:
    """SQL dictionary map: unknown or missing keys give NULL (pandas ``Series.map``)."""
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE `{col}` {whens} END AS {dtype})"


def _flag(col: str, value: str) -> str:
    """1 when ``col == value``; 0 for other values and for NULL (pandas ``==``)."""
    return f"coalesce(CAST(`{col}` = '{value}' AS INT), 0)"


def _ratio(num: str, den: str, cond: str | None = None) -> str:
    return f"CASE WHEN {cond or f'{den} > 0'} THEN {num} / {den} ELSE 0D END"


def flight_features(activity: DataFrame, base_year: int = S.BASE_YEAR, outside: str = "fail") -> DataFrame:
    """16 per-customer flight features from customer-month rows.

    A row outside the two observed years fails the job; ``outside="ignore"`` leaves such rows out.
    Expressions are SQL text (one JVM parse instead of a py4j call per node).
    """
    months = float(S.OBSERVATION_MONTHS)
    peak = ", ".join(str(m) for m in S.PEAK_MONTHS)
    within = F.col("year").isin(base_year, base_year + 1)
    if outside == "ignore":
        a = activity.where(within)
    else:
        a = activity.withColumn("year", F.when(within, F.col("year")).otherwise(
            F.raise_error(F.concat(F.lit("activity row outside the observed years: "), F.coalesce(F.col("year").cast("string"), F.lit("null"))))))
    aggs = [
        "sum(total_flights) AS total_flights_24m",
        "avg(total_flights) AS avg_monthly_flights",
        "coalesce(stddev_samp(total_flights), 0D) AS flight_consistency",
        "sum(flights_booked) AS total_flights_booked",
        "sum(companion_flights) AS _companions",
        "sum(distance) AS total_distance_24m",
        "sum(points_accumulated) AS points_accumulated_24m",
        "sum(points_redeemed) AS points_redeemed_24m",
        "sum(dollar_points_redeemed) AS dollar_points_redeemed_24m",
        f"avg(CASE WHEN year = {base_year} THEN total_flights END) AS _avg_y1",
        f"avg(CASE WHEN year = {base_year + 1} THEN total_flights END) AS _avg_y2",
        "count_if(total_flights > 0) AS _months_active",
        f"max(CASE WHEN total_flights > 0 THEN CASE WHEN year = {base_year} THEN month ELSE month + 12 END END)"
        " AS _last_flight",
        "count_if(points_redeemed > 0) AS _redemption_months",
        f"sum(CASE WHEN month IN ({peak}) THEN total_flights END) AS _peak",
    ]
    agg = a.groupBy("loyalty_number").agg(*[F.expr(x) for x in aggs])
    tf = "total_flights_24m"
    return agg.selectExpr(
        "loyalty_number", "total_flights_24m", "avg_monthly_flights", "flight_consistency",
        "total_flights_booked", "total_distance_24m", "points_accumulated_24m",
        "points_redeemed_24m", "dollar_points_redeemed_24m",
        "coalesce(_avg_y2, 0D) - coalesce(_avg_y1, 0D) AS flight_trend_yoy",
        f"{_ratio('_companions', tf)} AS companion_ratio",
        f"{_ratio('total_distance_24m', tf)} AS avg_distance_per_flight",
        "CASE WHEN points_accumulated_24m > 0 THEN least(points_redeemed_24m / points_accumulated_24m, 1D)"
        " ELSE 0D END AS points_utilization",
        "CAST(_months_active AS DOUBLE) AS months_active",
        f"{months}D - coalesce(CAST(_last_flight AS DOUBLE), 0D) AS recency_last_flight",
        f"_redemption_months / {months}D AS redemption_frequency",
        f"{_ratio('coalesce(_peak, 0D)', tf)} AS seasonal_peak_ratio",
    )


def loyalty_features(loyalty: DataFrame, end_year: int = S.BASE_YEAR + 1) -> DataFrame:
    """Loyalty columns + label + encoded loyalty features."""
    out = loyalty.selectExpr(
        "*",
        "CAST(cancellation_year IS NOT NULL AS INT) AS churn",
        f"CAST(({end_year} - enrollment_year) * 12 + (12 - enrollment_month) + 12 AS DOUBLE) AS tenure_months",
        f"{_case_map('loyalty_card', S.TIER_LEVELS)} AS loyalty_tier_numeric",
        f"{_flag('enrollment_type', S.PROMOTION_ENROLLMENT)} AS is_promotion_enrollee",
        f"{_flag('gender', S.MALE)} AS gender_encoded",
        f"{_case_map('education', S.EDUCATION_LEVELS)} AS education_encoded",
        *[f"{_flag('marital_status', v)} AS {k}" for k, v in S.MARITAL_DUMMIES.items()],
        *[f"{_flag('country', v)} AS {k}" for k, v in S.COUNTRY_DUMMIES.items()],
    )
    return out.selectExpr("*", f"{_ratio('clv', '(tenure_months / 12)', 'tenure_months > 0')} AS clv_per_year")


def category_levels(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a category column, sorted: as many as it has levels."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot_drop_first(df: DataFrame, column: str, prefix: str, levels: list[str]) -> DataFrame:
    """Generic dummy encoding: sorted ``levels``, first dropped, NULL → all zeros.

    ``levels`` are the category domain (e.g. from :func:`category_levels`).
    """
    lv = sorted(levels)[1:]
    return df.select("*", *[null_safe_flag(column, v).alias(f"{prefix}_{v}") for v in lv])


def feature_table(activity: DataFrame, loyalty: DataFrame, base_year: int = S.BASE_YEAR) -> DataFrame:
    """Loyalty ⟕ flight features, flight columns zero-filled, + 4 interactions.

    A customer without activity rows gets every flight feature 0 — including
    recency 0 (kept as in the original), unlike a customer with 24 zero months
    (recency 24).
    """
    flights = flight_features(activity, base_year)
    lf = loyalty_features(loyalty, base_year + 1)
    df = lf.join(flights, "loyalty_number", "left").fillna(0.0, subset=S.FLIGHT_FEATURES)
    tf = "total_flights_24m"
    return df.selectExpr(
        "*",
        f"{_ratio('clv', tf)} AS clv_per_flight",
        f"{_ratio('total_distance_24m', 'salary')} AS distance_per_salary",
        f"{_ratio('points_accumulated_24m', tf)} AS points_per_flight",
        f"{_ratio('total_distance_24m', 'clv')} AS miles_per_dollar_clv",
    )


def model_matrix(features: DataFrame, key: str = "loyalty_number", label: str | None = "churn",
                 feature_cols: list[str] = S.FEATURES) -> DataFrame:
    """PR5 — key + the 31 guarded model inputs in order (+ label).

    A feature column absent from the input is added as 0.
    """
    present = set(features.columns)
    cols = [f"`{key}`"]
    for c in feature_cols:
        cols.append(f"{model_input_sql(c) if c in present else '0D'} AS `{c}`")
    if label and label in present:
        cols.append(f"CAST(`{label}` AS INT) AS `{label}`")
    return features.selectExpr(*cols)


def missing_features(columns: list[str], feature_cols: list[str] = S.FEATURES) -> list[str]:
    """Feature columns that alignment will default to 0 (reported to the user)."""
    have = set(columns)
    return [c for c in feature_cols if c not in have]
