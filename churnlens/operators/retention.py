"""Retention: per-customer recommendations, action list, risk-tier summary,
campaign ROI grid and the strategy matrix applied to a scored table.

Rules are data (``schemas``); each report is a projection or one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import compare, py_grouped
from .segments import _stack, attach_scalar

P = "churn_probability"


def _rule_condition(df: DataFrame, feature: str, op: str, bound: float, absent: float | None = None):
    # A rule on an absent feature sees ``absent``, or never fires; a NULL value compares false.
    if feature not in df.columns:
        return F.lit(False) if absent is None else compare(F.lit(float(absent)), op, bound)
    return F.coalesce(compare(feature, op, bound), F.lit(False))


def _around(template: str) -> list[str]:
    """The template's text before and after its gap, the gap itself as an empty text."""
    before, after = template.split("{}")
    return [before, "", after]


def recommendations(scored: DataFrame, key: str = "loyalty_number",
                    max_items: int = S.MAX_RECOMMENDATIONS) -> DataFrame:
    """RE1 — up to 5 actions per customer, Critical first, then by priority
    (stable: rule order breaks ties).  One row per (customer, rank)."""
    items = []
    if "clv" in scored.columns:
        crit = F.coalesce((F.col("clv") > S.CRITICAL_CLV) & (F.col(P) > S.CRITICAL_PROBABILITY), F.lit(False))
        items.append(F.when(crit, F.struct(
            F.lit(S.PRIORITY_ORDER["Critical"]).alias("prio"), F.lit(-1).alias("ord"),
            F.lit("Critical").alias("priority"),
            F.concat(*[F.lit(t) if t else py_grouped("clv", 0) for t in _around(S.CRITICAL_ACTION)]).alias("action"),
            F.lit(S.CRITICAL_COST).alias("cost"), F.lit(S.CRITICAL_REASON).alias("reason"))))
    for i, (feat, op, bound, action, prio, cost, reason) in enumerate(S.RECOMMENDATION_RULES):
        items.append(F.when(_rule_condition(scored, feat, op, bound), F.struct(
            F.lit(S.PRIORITY_ORDER[prio]).alias("prio"), F.lit(i).alias("ord"), F.lit(prio).alias("priority"),
            F.lit(action).alias("action"), F.lit(cost).alias("cost"), F.lit(reason).alias("reason"))))
    # Struct order = (priority rank, rule order): sort_array is the stable priority sort.
    recs = F.slice(F.sort_array(F.array_compact(F.array(*items))), 1, max_items)
    return (scored.select(key, F.posexplode(recs).alias("pos", "r"))
            .select(key, (F.col("pos") + 1).alias("rank"), "r.priority", "r.action", "r.cost", "r.reason"))


def action_list(scored: DataFrame, key: str = "loyalty_number") -> DataFrame:
    """RE2 — High band: first two of four short actions joined by '; ', else a default.
    A column that the table lacks counts as 0."""
    items = F.array_compact(F.array(*[
        F.when(_rule_condition(scored, feat, op, bound, absent=0.0), F.lit(text))
        for feat, op, bound, text in S.ACTION_LIST_RULES]))
    actions = F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, 2), "; ")) \
               .otherwise(F.lit(S.ACTION_LIST_DEFAULT))
    return (scored.where(F.col("risk_level") == "High")
            .select(F.col(key).alias("customer_id"), "clv", P, actions.alias("recommended_actions")))


def risk_tier_summary(scored: DataFrame) -> DataFrame:
    """AG19 — per band: customers, total CLV, mean probability; plus the portfolio line."""
    g = scored.rollup("risk_level").agg(F.count(F.lit(1)).alias("customers"),
                                        F.sum("clv").alias("total_clv"),
                                        F.avg(P).alias("avg_probability"),
                                        F.grouping("risk_level").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col("risk_level")).alias("risk_level"),
                    "customers", "total_clv", "avg_probability")


def roi_grid(scored: DataFrame, segments=S.ROI_SEGMENTS, costs=S.ROI_COSTS,
             success_pcts=S.ROI_SUCCESS_PCTS) -> DataFrame:
    """AG20 — campaign ROI for every (segment, cost, success rate) of the calculator.

    The scored table is reduced to one aggregate row (count + mean CLV per
    segment, stacked to three rows); each segment row generates its 200
    (cost, success) grid points.
    saved = int(n × rate) with rate = pct / 100, as the calculator computes it.
    """
    aggs = []
    for i, (_, bands) in enumerate(segments):
        hit = F.col("risk_level").isin(bands)
        aggs += [F.count_if(hit).alias(f"n{i}"), F.avg(F.when(hit, F.col("clv"))).alias(f"c{i}")]
    stats = scored.agg(*aggs).select(_stack([(name, [f"n{i}", f"c{i}"]) for i, (name, _) in enumerate(segments)],
                                            ["segment", "target_count", "avg_clv"]))
    # The parameter grid is generated from the three segment rows (no join, no driver data).
    g = (stats.withColumn("cost_per_customer", F.explode(F.array(*[F.lit(int(c)) for c in costs])))
              .withColumn("success_pct", F.explode(F.array(*[F.lit(int(p)) for p in success_pcts]))))
    n = F.col("target_count")
    total_cost = (n * F.col("cost_per_customer")).cast("long")
    saved = (n * (F.col("success_pct") / F.lit(100.0))).cast("long")
    g = g.select("segment", "cost_per_customer", "success_pct", "target_count", "avg_clv",
                 total_cost.alias("total_cost"), saved.alias("customers_saved"))
    clv_saved = F.col("customers_saved") * F.col("avg_clv")
    g = g.withColumn("clv_saved", clv_saved)
    tc = F.col("total_cost")
    return (g.withColumn("roi_pct", F.when(tc > 0, (F.col("clv_saved") - tc) / tc * 100).otherwise(F.lit(0.0)))
             .withColumn("roi_multiple", F.when(tc > 0, F.col("clv_saved") / tc).otherwise(F.lit(0.0))))


def strategy_impact(scored: DataFrame, matrix=S.STRATEGY_MATRIX) -> DataFrame:
    """RE3 — the strategy matrix applied to the scored table, one pass:
    customers matching each driver (all and High band), their CLV, campaign cost,
    estimated saving and net."""
    aggs, pairs = [], []
    high = F.col("risk_level") == "High"
    for i, (driver, _, _, cost, save, feat, op, bound) in enumerate(matrix):
        hit = _rule_condition(scored, feat, op, bound)
        aggs += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & high).alias(f"h{i}"),
                 F.sum(F.when(hit, F.col("clv"))).alias(f"v{i}")]
        pairs.append((driver, [f"n{i}", f"h{i}", f"v{i}"]))
    stats = scored.agg(*aggs).select(_stack(pairs, ["driver", "customers", "high_risk_customers", "total_clv"]))
    dim = scored.sparkSession.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(d).alias("driver"), F.lit(a).alias("action"), F.lit(p).alias("priority"),
        F.lit(int(c)).alias("cost_per_customer"), F.lit(int(sv)).alias("est_save_per_customer"),
        F.lit(f"{f} {o} {b:g}").alias("target_segment")) for d, a, p, c, sv, f, o, b in matrix])))
    # both sides have one row per driver (5 rows)
    out = dim.join(F.broadcast(stats), "driver")
    cost = (F.col("customers") * F.col("cost_per_customer")).cast("long")
    save = (F.col("customers") * F.col("est_save_per_customer")).cast("long")
    return (out.withColumn("total_clv", F.coalesce("total_clv", F.lit(0.0)))
               .withColumn("campaign_cost", cost).withColumn("est_total_save", save)
               .withColumn("net_saving", save - cost))


__all__ = ["recommendations", "action_list", "risk_tier_summary", "roi_grid", "strategy_impact", "attach_scalar"]
