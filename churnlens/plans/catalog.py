"""Named query plans: ``(spark, sf_dir) → DataFrame``.

Each plan reads the driver tables and derives everything else with Spark, so
its work grows with the tables.  Doubles are rounded to 6 digits at the end of
oracle-checked plans (engines differ in the last bits of a mean or ratio).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import features as FT
from ..operators import segments as SG
from . import tables as TB

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


R = TB.round_doubles


# ----------------------------------------------------------------- inputs / features
@query("activity_monthly")
def q_activity_monthly(spark, d):
    return TB.activity(spark, d)


def _nullable_ints_as_double(df):
    # A nullable integer column (cancellation year) is exported as double so every
    # consumer reads the same values whatever its integer-with-NULL convention.
    return df.withColumn("cancellation_year", F.col("cancellation_year").cast("double"))


@query("loyalty_history")
def q_loyalty_history(spark, d):
    return _nullable_ints_as_double(TB.loyalty(spark, d))


@query("flight_features")
def q_flight_features(spark, d):
    return R(FT.flight_features(TB.activity(spark, d)))


@query("loyalty_features")
def q_loyalty_features(spark, d):
    return R(_nullable_ints_as_double(FT.loyalty_features(TB.loyalty(spark, d))))


@query("feature_table")
def q_feature_table(spark, d):
    return R(_nullable_ints_as_double(TB.features(spark, d)))


@query("model_matrix")
def q_model_matrix(spark, d):
    return R(FT.model_matrix(TB.feature_store(spark, d)))


# ----------------------------------------------------------------- segment reports
@query("portfolio_kpis")
def q_portfolio_kpis(spark, d):
    return R(SG.portfolio_kpis(TB.feature_store(spark, d)))


@query("tier_kpis")
def q_tier_kpis(spark, d):
    return R(SG.tier_kpis(TB.feature_store(spark, d)))


@query("churn_by_tier")
def q_churn_by_tier(spark, d):
    return R(SG.churn_by_tier(TB.feature_store(spark, d)))


@query("churn_by_enrollment")
def q_churn_by_enrollment(spark, d):
    return R(SG.churn_by_enrollment(TB.feature_store(spark, d)))


@query("churn_by_gender")
def q_churn_by_gender(spark, d):
    return R(SG.churn_by(TB.feature_store(spark, d), "gender", "gender", with_clv=False))


@query("churn_by_education")
def q_churn_by_education(spark, d):
    return R(SG.churn_by_education(TB.feature_store(spark, d)))


@query("churn_by_marital")
def q_churn_by_marital(spark, d):
    return R(SG.churn_by(TB.feature_store(spark, d), "marital_status", "marital_status", with_clv=False))


@query("churn_by_province_top10")
def q_churn_by_province_top10(spark, d):
    return R(SG.province_report(TB.feature_store(spark, d)))


@query("segment_grouping_sets")
def q_segment_grouping_sets(spark, d):
    return R(SG.segment_grouping_sets(TB.feature_store(spark, d)))


@query("segment_filtered_kpis")
def q_segment_filtered_kpis(spark, d):
    # Sidebar state: Star + Nova tiers, all enrollment types, no province, default ranges.
    return R(SG.segment_filtered_kpis(TB.feature_store(spark, d), tiers=["Star", "Nova"]))


@query("segment_filtered_provinces")
def q_segment_filtered_provinces(spark, d):
    """FI5 — two provinces chosen, the other options at their defaults."""
    return R(SG.segment_filtered_kpis(TB.feature_store(spark, d), provinces=["NATION_0", "NATION_3"]))


@query("balanced_sample")
def q_balanced_sample(spark, d):
    """SA1 — up to 100 rows of each class."""
    return SG.balanced_sample(TB.feature_store(spark, d), 200).select("loyalty_number", "churn")


@query("filter_domains")
def q_filter_domains(spark, d):
    return SG.filter_domains(TB.feature_store(spark, d))


@query("filter_values")
def q_filter_values(spark, d):
    return SG.filter_values(TB.feature_store(spark, d))


@query("one_hot_levels")
def q_one_hot_levels(spark, d):
    """PR4 — the generic encoding: the levels that the column holds, sorted, without the first."""
    f = TB.feature_store(spark, d).select("loyalty_number", "marital_status")
    return FT.one_hot_drop_first(f, "marital_status", "marital", FT.category_levels(f, "marital_status"))


@query("monthly_trend")
def q_monthly_trend(spark, d):
    f = TB.feature_store(spark, d)
    return R(SG.monthly_trend(TB.activity_store(spark, d), f.select("loyalty_number", "churn")))


@query("hist_flights")
def q_hist_flights(spark, d):
    return R(SG.histogram(TB.feature_store(spark, d), "total_flights_24m", 30))


@query("hist_trend")
def q_hist_trend(spark, d):
    return R(SG.histogram(TB.feature_store(spark, d), "flight_trend_yoy", 30))


@query("hist_utilization")
def q_hist_utilization(spark, d):
    return R(SG.histogram(TB.feature_store(spark, d), "points_utilization", 20))


@query("hist_recency")
def q_hist_recency(spark, d):
    return R(SG.histogram(TB.feature_store(spark, d), "recency_last_flight", 20))


def all_queries() -> dict[str, QueryFn]:
    # Import the modules that register the remaining plans.
    from . import catalog_io, catalog_models, catalog_scoring  # noqa: F401
    return dict(QUERIES)


__all__ = ["QUERIES", "all_queries", "query", "F", "S"]
