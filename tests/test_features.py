"""Hand fixtures for the missing-value and edge-case rules of the feature table."""

import math

from conftest import ACT_SCHEMA, LOY_SCHEMA, activity_rows

from churnlens import schemas as S
from churnlens.operators import features as FT


def _loyalty(key, **kw):
    base = dict(country="Canada", province="Ontario", gender="Male", education="College", salary=50000.0,
                marital_status="Married", loyalty_card="Star", clv=1000.0, enrollment_type="Standard",
                enrollment_year=2016, enrollment_month=6, cancellation_year=None)
    base.update(kw)
    return (key, base["country"], base["province"], base["gender"], base["education"], base["salary"],
            base["marital_status"], base["loyalty_card"], base["clv"], base["enrollment_type"],
            base["enrollment_year"], base["enrollment_month"], base["cancellation_year"])


def test_feature_edge_cases(spark):
    acts = []
    acts += activity_rows(2, {})                                    # 24 zero months
    acts += [(3, 2018, 5, 4.0, 4.0, 1.0, 40.0, 100.0, 0.0, 0.0)]    # a single row
    acts += activity_rows(4, {24: 3.0})                             # flights only in Dec of year 2
    acts += activity_rows(5, {1: 2.0}, red=500.0)                   # redeemed > accumulated
    activity = spark.createDataFrame(acts, ACT_SCHEMA)
    loyalty = spark.createDataFrame([
        _loyalty(1),                                                # no activity at all
        _loyalty(2, salary=None, clv=-5.0, loyalty_card="Diamond", education="PhD"),
        _loyalty(3, gender=None, enrollment_type=None, marital_status=None, cancellation_year=2018),
        _loyalty(4, enrollment_year=2018, enrollment_month=12, enrollment_type="2018 Promotion"),
        _loyalty(5, country="United States", marital_status="Single", salary=-10.0),
    ], LOY_SCHEMA)
    rows = {r["loyalty_number"]: r for r in FT.feature_table(activity, loyalty).collect()}

    # loyalty row without activity: flight features 0, recency 0 (not 24)
    assert rows[1]["total_flights_24m"] == 0 and rows[1]["recency_last_flight"] == 0
    assert rows[1]["months_active"] == 0
    # 24 zero months: recency 24, ratios 0, unknown tier / education missing, salary missing
    r2 = rows[2]
    assert r2["recency_last_flight"] == 24 and r2["companion_ratio"] == 0 and r2["points_utilization"] == 0
    assert r2["loyalty_tier_numeric"] is None and r2["education_encoded"] is None
    assert r2["distance_per_salary"] == 0 and r2["miles_per_dollar_clv"] == 0
    # one activity row: std 0, trend = that month's flights (year 2), single-row average
    r3 = rows[3]
    assert r3["flight_consistency"] == 0 and r3["flight_trend_yoy"] == 4.0 and r3["avg_monthly_flights"] == 4.0
    assert r3["gender_encoded"] == 0 and r3["is_promotion_enrollee"] == 0
    assert r3["marital_married"] == 0 and r3["marital_single"] == 0 and r3["churn"] == 1
    # last flight in month 24 → recency 0; enrolled Dec 2018 → tenure 12
    r4 = rows[4]
    assert r4["recency_last_flight"] == 0 and r4["tenure_months"] == 12 and r4["is_promotion_enrollee"] == 1
    assert math.isclose(r4["clv_per_year"], 1000.0)
    # redeemed > accumulated → utilization capped at 1; negative salary → ratio 0
    r5 = rows[5]
    assert r5["points_utilization"] == 1.0 and r5["distance_per_salary"] == 0
    assert r5["country_united_states"] == 1 and r5["marital_single"] == 1

    m = {r["loyalty_number"]: r for r in FT.model_matrix(FT.feature_table(activity, loyalty)).collect()}
    assert m[2]["loyalty_tier_numeric"] == 0.0 and m[2]["salary"] == 0.0       # missing → 0 in the matrix
    assert list(m[1].asDict())[1:32] == S.FEATURES


def test_model_matrix_adds_absent_columns(spark):
    df = spark.createDataFrame([(1, 5.0, float("nan"), float("inf"))],
                               "loyalty_number long, total_flights_24m double, clv double, salary double")
    r = FT.model_matrix(df, label=None).first()
    assert r["total_flights_24m"] == 5.0 and r["clv"] == 0.0 and r["salary"] == 0.0
    assert r["tenure_months"] == 0.0
    assert FT.missing_features(df.columns)[:3] == ["avg_monthly_flights", "flight_consistency",
                                                   "total_flights_booked"]


def test_feature_plan_is_one_aggregate_without_python(spark):
    activity = spark.createDataFrame(activity_rows(1, {3: 1.0}), ACT_SCHEMA)
    plan = FT.flight_features(activity)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    # one aggregate (partial + final) over activity, no self-joins
    assert plan.count("HashAggregate") == 2 and "Join" not in plan
