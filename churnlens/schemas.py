"""Schemas, column contracts and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Input schemas (snake_case).  CSV headers are mapped onto these by the readers.
# --------------------------------------------------------------------------
ACTIVITY = T.StructType([
    T.StructField("loyalty_number", T.LongType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("month", T.IntegerType(), False),
    T.StructField("total_flights", T.DoubleType(), True),
    T.StructField("flights_booked", T.DoubleType(), True),
    T.StructField("companion_flights", T.DoubleType(), True),
    T.StructField("distance", T.DoubleType(), True),
    T.StructField("points_accumulated", T.DoubleType(), True),
    T.StructField("points_redeemed", T.DoubleType(), True),
    T.StructField("dollar_points_redeemed", T.DoubleType(), True),
])

LOYALTY = T.StructType([
    T.StructField("loyalty_number", T.LongType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("province", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("education", T.StringType(), True),
    T.StructField("salary", T.DoubleType(), True),
    T.StructField("marital_status", T.StringType(), True),
    T.StructField("loyalty_card", T.StringType(), True),
    T.StructField("clv", T.DoubleType(), True),
    T.StructField("enrollment_type", T.StringType(), True),
    T.StructField("enrollment_year", T.IntegerType(), True),
    T.StructField("enrollment_month", T.IntegerType(), True),
    T.StructField("cancellation_year", T.IntegerType(), True),
])

# ==========================================================================
# FIXED VALUES — these must equal the original application's for identical
# results.  Stated plainly and in their natural order.
# ==========================================================================

# CSV header → canonical column name.
ACTIVITY_HEADERS = {
    "Loyalty Number": "loyalty_number", "Year": "year", "Month": "month",
    "Total Flights": "total_flights", "Flights Booked": "flights_booked",
    "Flights with Companions": "companion_flights", "Distance": "distance",
    "Points Accumulated": "points_accumulated", "Points Redeemed": "points_redeemed",
    "Dollar Cost Points Redeemed": "dollar_points_redeemed",
}
LOYALTY_HEADERS = {
    "Loyalty Number": "loyalty_number", "Country": "country", "Province": "province",
    "Gender": "gender", "Education": "education", "Salary": "salary",
    "Marital Status": "marital_status", "Loyalty Card": "loyalty_card", "CLV": "clv",
    "Enrollment Type": "enrollment_type", "Enrollment Year": "enrollment_year",
    "Enrollment Month": "enrollment_month", "Cancellation Year": "cancellation_year",
}
# Model feature names of the original feature file → canonical names.
FEATURE_HEADERS = {
    "Salary": "salary", "CLV": "clv", "marital_Married": "marital_married",
    "marital_Single": "marital_single", "country_United States": "country_united_states",
}

# Model feature order (31 features).
FEATURES = [
    "total_flights_24m", "avg_monthly_flights", "flight_consistency",
    "total_flights_booked", "total_distance_24m", "points_accumulated_24m",
    "points_redeemed_24m", "dollar_points_redeemed_24m", "flight_trend_yoy",
    "companion_ratio", "avg_distance_per_flight", "points_utilization",
    "months_active", "recency_last_flight", "redemption_frequency",
    "seasonal_peak_ratio", "tenure_months", "loyalty_tier_numeric",
    "is_promotion_enrollee", "clv_per_year", "gender_encoded", "education_encoded",
    "salary", "clv", "marital_married", "marital_single", "country_united_states",
    "clv_per_flight", "distance_per_salary", "points_per_flight", "miles_per_dollar_clv",
]
# The 16 per-customer flight features (zero-filled after the loyalty join).
FLIGHT_FEATURES = FEATURES[:16]
# The 4 interaction features.
INTERACTION_FEATURES = FEATURES[27:]

BASE_YEAR = 2017                 # month index 1..12 for this year, 13..24 for the next
OBSERVATION_MONTHS = 24
PEAK_MONTHS = [6, 7, 8, 12]

TIER_LEVELS = {"Star": 1, "Nova": 2, "Aurora": 3}
EDUCATION_LEVELS = {
    "High School or Below": 1, "College": 2, "Bachelor": 3, "Master": 4, "Doctor": 5,
}
PROMOTION_ENROLLMENT = "2018 Promotion"
MALE = "Male"
MARITAL_DUMMIES = {"marital_married": "Married", "marital_single": "Single"}
COUNTRY_DUMMIES = {"country_united_states": "United States"}

RISK_HIGH = 0.6                  # probability >= 0.6 → High
RISK_MEDIUM = 0.3                # probability >= 0.3 → Medium, else Low
DEFAULT_THRESHOLD = 0.5          # decision threshold when none is stored
STATUS_LABELS = {0: "Active", 1: "Churned"}
PROVINCE_RATE_BANDS = (18.0, 15.0)     # rate % > 18 high, > 15 elevated
ENROLLMENT_RATE_BANDS = (20.0, 15.0)   # rate % > 20 high, > 15 elevated

# Threshold sweep: the 16 values of numpy.arange(0.1, 0.9, 0.05), bit for bit.
SWEEP_THRESHOLDS = [
    0.1, 0.15000000000000002, 0.20000000000000004, 0.25000000000000006,
    0.30000000000000004, 0.3500000000000001, 0.40000000000000013, 0.45000000000000007,
    0.5000000000000001, 0.5500000000000002, 0.6000000000000002, 0.6500000000000001,
    0.7000000000000002, 0.7500000000000002, 0.8000000000000002, 0.8500000000000002,
]

# ROI calculator domain: cost per customer 10..200 step 10, success rate 5..50 % step 5.
ROI_SEGMENTS = [
    ("High Risk Only", ["High"]),
    ("High + Medium Risk", ["High", "Medium"]),
    ("All At-Risk Customers", ["High", "Medium"]),
]
ROI_COSTS = list(range(10, 201, 10))
ROI_SUCCESS_PCTS = list(range(5, 51, 5))

# Per-customer recommendation rules, in rule order:
# (feature, comparison, bound, action, priority, cost, reason)
RECOMMENDATION_RULES = [
    ("flight_trend_yoy", "<", 0.0, "Targeted fare discount (15% off next booking)",
     "High", "$50/customer", "Declining flight activity"),
    ("points_utilization", "<", 0.3, "Points expiry warning + bonus redemption catalog",
     "Medium", "$10/customer", "Low points engagement"),
    ("is_promotion_enrollee", "==", 1.0, "Welcome series + personal onboarding call",
     "High", "$25/customer", "Promotion enrollee (high churn segment)"),
    ("companion_ratio", "<", 0.2, "Family/group booking incentive (2-for-1 companion)",
     "Medium", "$30/customer", "Low companion travel"),
    ("recency_last_flight", ">", 6.0, "Win-back campaign with exclusive offer",
     "Medium", "$15/customer", "Lapsed traveler"),
    ("redemption_frequency", "<", 0.1, "Points bonus multiplier for next redemption",
     "Low", "$20/customer", "Rare points redemption"),
]
CRITICAL_CLV = 5000.0            # CLV > 5000 and probability > 0.5 → Critical rule first
CRITICAL_PROBABILITY = 0.5
CRITICAL_ACTION = "Priority outreach - Assign personal account manager (CLV: ${})"
CRITICAL_COST = "$100/customer"
CRITICAL_REASON = "High-value customer at risk"
PRIORITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
MAX_RECOMMENDATIONS = 5

# Short action list for the High band: (feature, comparison, bound, text); first two kept.
ACTION_LIST_RULES = [
    ("flight_trend_yoy", "<", 0.0, "Targeted fare discount"),
    ("points_utilization", "<", 0.3, "Points engagement campaign"),
    ("is_promotion_enrollee", "==", 1.0, "Personal onboarding call"),
    ("recency_last_flight", ">", 6.0, "Win-back campaign"),
]
ACTION_LIST_DEFAULT = "General retention outreach"

# Strategy matrix: (driver, action, priority, cost $, est. saving $, feature, comparison, bound)
STRATEGY_MATRIX = [
    ("Declining Flights", "Targeted fare discount (15% off)", "High", 50, 2100,
     "flight_trend_yoy", "<", 0.0),
    ("Low Points Utilization", "Points expiry warning + bonus catalog", "Medium", 10, 800,
     "points_utilization", "<", 0.3),
    ("Promotion Enrollee", "Welcome series + onboarding call", "High", 25, 1500,
     "is_promotion_enrollee", "==", 1.0),
    ("Low Companion Travel", "Family/group booking incentive", "Medium", 30, 950,
     "companion_ratio", "<", 0.2),
    ("Lapsed Traveler", "Win-back campaign with exclusive offer", "Low", 15, 400,
     "recency_last_flight", ">", 6.0),
]

# Fixture score (a fixed-weight logistic over five features) used to make every
# score consumer checkable without a fitted model.
FIXTURE_WEIGHTS = {
    "recency_last_flight": 0.15, "flight_trend_yoy": -0.8, "total_flights_24m": -0.05,
    "points_utilization": -0.5, "is_promotion_enrollee": 0.3,
}
FIXTURE_INTERCEPT = -1.0

# Deterministic stratified split: smallest md5 of "<key>-<seed>" (test) / "<key>-<seed>-val" (validation) per class.
SPLIT_SEED = 42
TEST_SHARE = 0.15                # of all rows
VALIDATION_SHARE = 0.176         # of the remainder
OVERSAMPLE_RATIO = 0.4           # minority brought to 0.4 × majority (train rows only)
OVERSAMPLE_NEIGHBORS = 5

# Booster search space (categorical choices of the original search).
SEARCH_SPACE = {
    "n_estimators": [100, 300, 500, 700],
    "max_depth": [3, 5, 7, 9, -1],
    "learning_rate": [0.01, 0.05, 0.1],
    "num_leaves": [15, 31, 63, 127],
    "min_child_samples": [10, 20, 50],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8, 0.9],
    "reg_alpha": [0, 0.1, 1.0],
    "reg_lambda": [0, 0.1, 1.0],
}
GRID_SPACE = {
    "n_estimators": [300, 500], "max_depth": [5, 7], "learning_rate": [0.05, 0.1],
    "num_leaves": [31, 63], "min_child_samples": [20], "subsample": [0.8],
    "colsample_bytree": [0.8], "reg_alpha": [0.1], "reg_lambda": [0.1],
}
STORED_PARAMS = {
    "n_estimators": 300, "max_depth": 3, "learning_rate": 0.1, "num_leaves": 15,
    "min_child_samples": 50, "subsample": 0.7, "colsample_bytree": 0.7,
    "reg_alpha": 1.0, "reg_lambda": 0.1,
}
SEARCH_TRIALS = 30

# ==========================================================================
# FIXTURE ENSEMBLE — our own: eight boosted trees fitted once on a small table and rounded.  With it every
# plan over a tree model is checkable without fitting one.  (feature, threshold, left, right) down to leaf
# values in log-odds; a row goes left where feature <= threshold.
# ==========================================================================
FIXTURE_TREES = [
    ("recency_last_flight", 5.5,
     ("avg_monthly_flights", 0.0208, ("tenure_months", 71.5, 0.0, 0.72), -2.0),
     ("flight_consistency", 1.963, ("companion_ratio", 0.2546, 0.4211, 0.9554), ("distance_per_salary", 0.0051, -1.2727, 0.6341))),
    ("seasonal_peak_ratio", 0.0742,
     ("recency_last_flight", 8.5, ("salary", 93203.0, -0.0514, -0.5393), ("points_redeemed_24m", 18.5, 0.3914, 0.0746)),
     ("recency_last_flight", 5.5, -0.2861, ("points_utilization", 0.3853, 0.0334, -0.5232))),
    ("recency_last_flight", 5.5,
     ("months_active", 0.5, ("tenure_months", 76.5, 0.2663, -0.0635), ("salary", 93203.0, -0.2322, -0.2127)),
     ("tenure_months", 82.5, ("education_encoded", 1.5, -0.1307, 0.1513), ("points_utilization", 0.2536, -0.7885, -0.0862))),
    ("recency_last_flight", 5.5,
     ("total_flights_24m", 0.5, ("tenure_months", 80.5, -0.0743, 0.2023), ("salary", 93203.0, -0.1879, -0.1749)),
     ("tenure_months", 79.5, ("points_accumulated_24m", 2946.5, -0.1245, 0.15), ("loyalty_tier_numeric", 1.5, -0.3574, 0.0332))),
    ("total_flights_24m", 8.5,
     ("flight_consistency", 1.274, ("points_utilization", 0.3853, 0.0438, -0.2712), 0.421),
     ("points_redeemed_24m", 1098.5, ("recency_last_flight", 8.5, -0.125, -0.6286), ("recency_last_flight", 5.5, -0.1551, 0.032))),
    ("recency_last_flight", 5.5,
     ("flight_consistency", 0.1021, ("tenure_months", 76.5, 0.1333, -0.1194), ("seasonal_peak_ratio", 0.0501, -0.1644, -0.1347)),
     ("avg_distance_per_flight", 31.4359, ("flight_consistency", 2.3847, 0.0782, -0.4014), ("flight_trend_yoy", -0.37, 0.1486, -0.5043))),
    ("recency_last_flight", 5.5,
     ("points_accumulated_24m", 56.5, ("salary", 25060.0, -0.1789, 0.073), ("total_flights_24m", 8.5, -0.144, -0.1185)),
     ("tenure_months", 57.5, 0.2955, ("salary", 105172.0, 0.011, -0.4981))),
    ("clv", 9683.815,
     ("avg_monthly_flights", 0.3542, ("companion_ratio", 0.2034, 0.1444, -0.0275), ("seasonal_peak_ratio", 0.7091, -0.048, -0.3697)),
     ("companion_ratio", 0.3288, -0.5875, -0.1132)),
]
