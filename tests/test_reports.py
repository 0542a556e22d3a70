"""Reports, bands, recommendations and formatting rules."""

from churnlens import schemas as S
from churnlens.functions import py_fixed, py_grouped, py_percent, title_case
from churnlens.operators import retention as RT
from churnlens.operators import scoring as SC
from churnlens.operators import segments as SG
from pyspark.sql import functions as F

SCORED = ("loyalty_number long, clv double, churn_probability double, flight_trend_yoy double, "
          "points_utilization double, is_promotion_enrollee int, companion_ratio double, "
          "recency_last_flight double, redemption_frequency double")


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(1, 0.6), (2, 0.3), (3, 0.2999), (4, 0.7)], "loyalty_number long, churn_probability double")
    out = {r["loyalty_number"]: (r["risk_level"], r["predicted_churn"])
           for r in SC.add_bands(df, 0.75227).collect()}
    assert out == {1: ("High", 0), 2: ("Medium", 0), 3: ("Low", 0), 4: ("High", 0)}
    counts = {r["risk_level"]: r["customers"] for r in SC.risk_band_counts(df).collect()}
    assert counts == {"High": 2, "Medium": 1, "Low": 1}


def test_recommendations_priority_and_cut(spark):
    df = spark.createDataFrame([
        (1, 9000.0, 0.9, -1.0, 0.1, 1, 0.1, 10.0, 0.0),     # all six rules + critical
        (2, 5000.0, 0.5, 1.0, 0.5, 0, 0.5, 1.0, 0.5),       # CLV 5000, p 0.5 exactly: nothing fires
        (3, None, 0.9, None, 0.5, 0, 0.5, 1.0, 0.05),       # missing values compare false
    ], SCORED)
    recs = RT.recommendations(df).orderBy("loyalty_number", "rank").collect()
    one = [(r["rank"], r["priority"], r["cost"]) for r in recs if r["loyalty_number"] == 1]
    assert one == [(1, "Critical", "$100/customer"), (2, "High", "$50/customer"), (3, "High", "$25/customer"),
                   (4, "Medium", "$10/customer"), (5, "Medium", "$30/customer")]
    assert recs[0]["action"] == "Priority outreach - Assign personal account manager (CLV: $9,000)"
    assert not [r for r in recs if r["loyalty_number"] == 2]
    assert [(r["priority"], r["reason"]) for r in recs if r["loyalty_number"] == 3] == [("Low", "Rare points redemption")]


def test_action_list_keeps_first_two(spark):
    df = spark.createDataFrame([(1, 100.0, 0.9, -1.0, 0.1, 1, 0.5, 9.0, 0.5),
                                (2, 100.0, 0.9, 1.0, 0.5, 0, 0.5, 1.0, 0.5)], SCORED)
    df = SC.add_bands(df)
    out = {r["customer_id"]: r["recommended_actions"] for r in RT.action_list(df).collect()}
    assert out == {1: "Targeted fare discount; Points engagement campaign", 2: S.ACTION_LIST_DEFAULT}


def test_segment_filter_lists(spark):
    df = spark.createDataFrame([(1, "Star", "Standard", "A", 100.0, 10.0, 1, 10.0, 5.0),
                                (2, "Nova", "Standard", "B", None, 20.0, 0, 20.0, 6.0),
                                (3, "Star", "2018 Promotion", "B", 300.5, 30.0, 0, 30.0, 7.0)],
                               "loyalty_number long, loyalty_card string, enrollment_type string, province string, "
                               "salary double, tenure_months double, churn int, clv double, total_flights_24m double")
    kpi = SG.segment_filtered_kpis(df, tiers=[]).first()
    assert kpi["filtered_customers"] == 0 and kpi["churn_rate"] is None           # empty tier list: nothing
    kpi = SG.segment_filtered_kpis(df, provinces=[]).first()
    # default ranges drop the missing salary and the truncated fractional maximum (300.5 > 300)
    assert kpi["filtered_customers"] == 1 and kpi["total_customers"] == 3


def test_python_formatting_rules(spark):
    vals = [0.25, 2.675, 1234.5, 1235.5, -1234.567, 0.125, 99.95]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select(py_fixed("v", 1).alias("a"), py_grouped("v", 0).alias("b"), py_grouped("v", 2).alias("c"),
                    py_percent("v", 0).alias("d")).collect()
    for v, r in zip(vals, got):
        assert r["a"] == f"{v:.1f}" and r["b"] == f"{v:,.0f}" and r["c"] == f"{v:,.2f}"
        assert r["d"] == f"{v:.0%}"
    names = spark.createDataFrame([(f,) for f in S.FEATURES], "f string")
    assert [r[0] for r in names.select(title_case("f")).collect()] == [f.replace("_", " ").title() for f in S.FEATURES]


def test_roi_grid_formula(spark):
    df = spark.createDataFrame([(i, 100.0 * i, "High" if i < 7 else "Medium") for i in range(1, 11)],
                               "loyalty_number long, clv double, risk_level string")
    g = RT.roi_grid(df).where((F.col("segment") == "High Risk Only") & (F.col("cost_per_customer") == 50)
                              & (F.col("success_pct") == 35)).first()
    n, avg = 6, sum(100.0 * i for i in range(1, 7)) / 6
    saved = int(n * (35 / 100))
    assert g["customers_saved"] == saved and g["total_cost"] == n * 50
    assert abs(g["roi_pct"] - (saved * avg - n * 50) / (n * 50) * 100) < 1e-9
    assert RT.roi_grid(df).count() == 3 * 20 * 10
