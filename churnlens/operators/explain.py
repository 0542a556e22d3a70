"""Attributions and their consumers.

An attribution table is long: (key, feature, feature_index, feature_value,
shap_value) plus a one-row base value.  Producers: :func:`linear_attribution`
(exact for a linear margin: w·(x − mean)) and ``treeshap.tree_attribution``.
Consumers (top factors, explanation text, waterfall rows, global importance,
dependence bins) work on any producer's output.  Per-customer windows are
partitioned by customer (≤ 31 rows each); global summaries are partial
aggregates over ≤ 31 features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import py_fixed, py_grouped, py_percent, title_case
from .ranking import percent_ranks
from .segments import attach_scalar


def long_features(matrix: DataFrame, key: str = "loyalty_number",
                  features: list[str] = S.FEATURES) -> DataFrame:
    """Wide model matrix → (key, feature, feature_index, feature_value)."""
    pairs = ", ".join(f"named_struct('feature', '{f}', 'feature_index', {i}, "
                      f"'feature_value', CAST(`{f}` AS DOUBLE))" for i, f in enumerate(features))
    return matrix.selectExpr(f"`{key}`", f"inline(array({pairs}))")


def feature_table_df(spark, values: dict[str, float], features: list[str] = S.FEATURES,
                     name: str = "weight") -> DataFrame:
    """(feature, feature_index, <name>) for every model feature (missing → 0)."""
    rows = ", ".join(f"named_struct('feature', '{f}', 'feature_index', {i}, "
                     f"'{name}', CAST({float(values.get(f, 0.0))!r} AS DOUBLE))" for i, f in enumerate(features))
    return spark.range(1).selectExpr(f"inline(array({rows}))")


def linear_attribution(matrix: DataFrame, background: DataFrame, weights: dict[str, float],
                       intercept: float, key: str = "loyalty_number",
                       features: list[str] = S.FEATURES) -> tuple[DataFrame, DataFrame]:
    """Exact additive attribution of a linear margin: φ_f = w_f · (x_f − E_bg[x_f]).

    ``background`` is the reference population (e.g. the training split) —
    its feature means are one aggregate row.  Returns (long table, base value),
    base = b + Σ w·mean, so base + Σ φ = margin for every row.
    """
    spark = matrix.sparkSession
    means = background.selectExpr(*[f"avg(`{f}`) AS `{f}`" for f in features])
    mean_long = means.selectExpr("inline(array(" + ", ".join(
        f"named_struct('feature', '{f}', 'mean', `{f}`)" for f in features) + "))")
    w = feature_table_df(spark, weights, features).join(mean_long, "feature")
    # ``w`` has one row per model feature: a bounded broadcast side.
    longf = long_features(matrix, key, features).join(F.broadcast(w.drop("feature_index")), "feature")
    values = longf.select(key, "feature", "feature_index", "feature_value",
                          (F.col("weight") * (F.col("feature_value") - F.col("mean"))).alias("shap_value"))
    base = w.agg((F.sum(F.col("weight") * F.col("mean")) + F.lit(float(intercept))).alias("base_value"))
    return values, base


def linear_factors(matrix: DataFrame, background: DataFrame, weights: dict[str, float], intercept: float,
                   key: str = "loyalty_number", features: list[str] = S.FEATURES) -> DataFrame:
    """One row per customer: ``factors`` (feature structs, largest |φ| first) and ``base_value``.

    The attributions of :func:`linear_attribution` in the row they belong to: consumers slice the
    array, so nothing is exploded or shuffled by customer.
    """
    w = {f: float(weights.get(f, 0.0)) for f in features}
    means = background.selectExpr(
        *[f"avg(`{f}`) AS `_m_{f}`" for f in features],
        " + ".join([f"{float(intercept)!r}D"] + [f"{w[f]!r}D * avg(`{f}`)" for f in features]) + " AS base_value")
    phi = {f: f"{w[f]!r}D * (`{f}` - `_m_{f}`)" for f in features}
    structs = ", ".join(f"named_struct('o', -abs({phi[f]}), 'feature_index', {i}, 'feature', '{f}', "
                        f"'feature_value', CAST(`{f}` AS DOUBLE), 'shap_value', {phi[f]})" for i, f in enumerate(features))
    return attach_scalar(matrix.select(key, *features), means).selectExpr(
        key, f"sort_array(array({structs})) AS factors", "base_value")


def linear_arrays(matrix: DataFrame, background: DataFrame, weights: dict[str, float], intercept: float,
                  key: str = "loyalty_number", features: list[str] = S.FEATURES) -> tuple[DataFrame, DataFrame]:
    """:func:`linear_attribution` as one row per customer: ``(key, phi)`` in the features' order, and the base value."""
    w = {f: float(weights.get(f, 0.0)) for f in features}
    means = background.selectExpr(
        *[f"avg(`{f}`) AS `_m_{f}`" for f in features],
        " + ".join([f"{float(intercept)!r}D"] + [f"{w[f]!r}D * avg(`{f}`)" for f in features]) + " AS base_value")
    phi = ", ".join(f"{w[f]!r}D * (`{f}` - `_m_{f}`)" for f in features)
    return (attach_scalar(matrix.select(key, *features), means).selectExpr(f"`{key}`", f"array({phi}) AS phi"),
            means.select("base_value"))


def top_of(factors: DataFrame, n: int = 5, key: str = "loyalty_number") -> DataFrame:
    """EX2 / SO7 from :func:`linear_factors`: the first n of each customer's sorted factors."""
    r = factors.select(key, F.posexplode(F.slice("factors", 1, n)).alias("pos", "r"))
    return r.select(key, "r.feature", "r.feature_index", "r.feature_value", "r.shap_value",
                    (F.col("pos") + 1).alias("rank"),
                    F.when(F.col("r.shap_value") > 0, "increases").otherwise("decreases").alias("direction"))


def explanations_of(factors: DataFrame, n: int = 5, key: str = "loyalty_number") -> DataFrame:
    """EX3 from :func:`linear_factors`."""
    return top_of(factors, n, key).select(
        key, "rank", "feature", explanation_text().alias("text"),
        F.when(F.col("shap_value") > 0, "risk factor").otherwise("retention factor").alias("impact"), "shap_value")


def waterfall_of(factors: DataFrame, max_display: int = 10, key: str = "loyalty_number") -> DataFrame:
    """EX4 from :func:`linear_factors`: bars of the first features and one for the rest."""
    k = max_display - 1
    total = "aggregate({}, 0D, (s, x) -> s + x.shap_value)"
    bars = factors.selectExpr(
        key, "base_value", "factors", f"size(factors) - {k} AS n_rest",
        f"posexplode(slice(factors, 1, {max_display})) AS (pos, r)").withColumn("position", F.col("pos") + 1)
    last = F.col("position") == max_display
    bars = bars.withColumn("value", F.when(last, F.expr(total.format(f"slice(factors, {max_display}, size(factors))")))
                           .otherwise(F.col("r.shap_value")))
    bars = bars.withColumn("end", F.col("base_value") + F.expr(total.format("slice(factors, position, size(factors))")))
    return bars.select(key, "position",
                       F.when(last, F.concat(F.col("n_rest").cast("string"), F.lit(" other features")))
                       .otherwise(F.col("r.feature")).alias("label"),
                       F.when(~last, F.col("r.feature_value")).alias("feature_value"), "value",
                       (F.col("end") - F.col("value")).alias("start"), "end")


def top_factor(attr: DataFrame, key: str = "loyalty_number") -> DataFrame:
    """n = 1 as a plain aggregate: max_by over (|φ|, −index)."""
    return attr.groupBy(key).agg(F.max_by("feature", F.struct(F.abs("shap_value"), -F.col("feature_index")))
                                 .alias("top_risk_factor"))


def explanation_text(feature: str = "feature", v: str = "feature_value"):
    """EX3 — plain-language text per feature (12 templates, generic fallback)."""
    # FIXED VALUES: the texts must equal the original's.
    f, x = F.col(feature), F.col(v)
    header = f                                        # features that the original names otherwise
    for name, own in S.FEATURE_HEADERS.items():
        header = F.when(f == own, name).otherwise(header)
    whole = x.cast("long").cast("string")
    tier = F.when(x == 1, "Star").when(x == 2, "Nova").otherwise("Aurora")
    return (F.when(f == "flight_trend_yoy", F.concat(
                F.lit("Flight activity "), F.when(x < 0, "decreased").otherwise("increased"),
                F.lit(" by "), py_fixed(F.abs(x), 1), F.lit(" flights year-over-year")))
            .when(f == "recency_last_flight", F.when(x > 0, F.concat(F.lit("Last flight was "), whole,
                                                                      F.lit(" months ago")))
                  .otherwise(F.lit("Recently active flyer")))
            .when(f == "total_flights_24m", F.concat(F.when(x < 10, "Only ").otherwise(""), whole,
                                                      F.lit(" total flights in 24 months")))
            .when(f == "is_promotion_enrollee", F.when(
                x == 1, "Enrolled through 2018 promotion (higher churn risk segment)")
                  .otherwise("Standard enrollment"))
            .when(f == "points_utilization", F.concat(F.when(x < 0.3, "Low").otherwise("High"),
                                                       F.lit(" points utilization ("), py_percent(x, 0), F.lit(")")))
            .when(f == "clv", F.concat(F.lit("Customer Lifetime Value: $"), py_grouped(x, 2)))
            .when(f == "clv_per_year", F.concat(F.lit("Annualized CLV: $"), py_grouped(x, 2)))
            .when(f == "tenure_months", F.concat(F.lit("Member for "), whole, F.lit(" months")))
            .when(f == "companion_ratio", F.concat(py_percent(x, 0), F.lit(" of flights with companions")))
            .when(f == "months_active", F.concat(F.lit("Active in "), whole, F.lit(" of 24 months")))
            .when(f == "loyalty_tier_numeric", F.concat(tier, F.lit(" tier member")))
            .when(f == "redemption_frequency", F.concat(F.lit("Redeems points "), py_percent(x, 0),
                                                         F.lit(" of months")))
            .otherwise(F.concat(header, F.lit(": "), py_fixed(x, 2))))


def global_importance(attr: DataFrame) -> DataFrame:
    """AG21 / EX5 — mean |φ| per feature, ranked (ties: feature order)."""
    g = attr.groupBy("feature", "feature_index").agg(F.avg(F.abs("shap_value")).alias("importance"))
    # ≤ one row per model feature: the ranking window is bounded.
    w = Window.orderBy(F.desc("importance"), F.asc("feature_index"))
    return g.select("feature", "feature_index", title_case("feature").alias("display_name"),
                    "importance", F.row_number().over(w).alias("rank"))


def dependence_data(attr: DataFrame, importance: DataFrame, top: int = 3, bins: int = 20) -> DataFrame:
    """EX7 — for the top features: equal-width value bins with mean attribution."""
    top_f = importance.where(F.col("rank") <= top).select("feature", "rank")
    a = attr.join(F.broadcast(top_f), "feature")
    bounds = a.groupBy("feature").agg(F.min("feature_value").alias("_lo"), F.max("feature_value").alias("_hi"))
    a = a.join(F.broadcast(bounds), "feature")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor(F.round((F.col("feature_value") - F.col("_lo")) / width * bins, 9)) + 1,
                                  F.lit(bins))).otherwise(F.lit(1)).cast("long")
    return (a.withColumn("bin", b).groupBy("feature", "rank", "bin")
            .agg(F.min("feature_value").alias("value_min"), F.max("feature_value").alias("value_max"),
                 F.avg("shap_value").alias("mean_shap"), F.count(F.lit(1)).alias("count")))


def beeswarm_data(attr: DataFrame, importance: DataFrame, top: int = 15, key: str = "loyalty_number") -> DataFrame:
    """EX6 — every row's attribution of the top features, with the percent rank of its value within the feature
    (the colour of the plot)."""
    top_f = importance.where(F.col("rank") <= top).select("feature", "rank")
    # ``top_f`` has one row per top feature: a bounded broadcast side.
    some = attr.join(F.broadcast(top_f), "feature").select(key, "feature", "rank", "feature_value", "shap_value")
    return percent_ranks(some, "feature_value", ["feature"], "value_percent_rank")
