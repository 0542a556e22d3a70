"""DuckDB oracle SQL for the named plans.

Each statement re-derives its inputs from the driver tables with plain SQL
(CTEs), independently of the Spark code, and rounds derived doubles to 6
digits exactly where the Spark plan does.
"""

from __future__ import annotations

from .. import schemas as S

ORACLE: dict[str, str] = {}


def r6(*cols: str) -> str:
    return ", ".join(f"(round({c}, 6) + 0.0)::DOUBLE AS {c}" for c in cols)


ACTIVITY_CTE = """
li AS (
  SELECT o.o_custkey AS loyalty_number,
         CAST(year(o.o_orderdate) + 18 AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         l.l_quantity, l.l_extendedprice, l.l_discount, l.l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderdate >= TIMESTAMP '1999-01-01' AND o.o_orderdate < TIMESTAMP '2001-01-01'),
sparse AS (
  SELECT loyalty_number, year, month,
         COUNT(*)::DOUBLE AS total_flights,
         (COUNT(*) FILTER (WHERE l_returnflag <> 'R'))::DOUBLE AS flights_booked,
         (COUNT(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS companion_flights,
         SUM(l_quantity)::DOUBLE AS distance,
         SUM(floor(l_extendedprice / 100))::DOUBLE AS points_accumulated,
         SUM(CASE WHEN l_discount > 0.075 THEN floor(l_extendedprice / 100) ELSE 0 END)::DOUBLE AS points_redeemed,
         SUM(CASE WHEN l_discount > 0.075 THEN floor(l_extendedprice / 1000) ELSE 0 END)::DOUBLE AS dollar_points_redeemed
  FROM li GROUP BY loyalty_number, year, month),
cal AS (SELECT CAST(2017 + i // 12 AS INTEGER) AS year, CAST(i % 12 + 1 AS INTEGER) AS month FROM range(24) t(i)),
activity AS (
  SELECT CAST(k.loyalty_number AS BIGINT) AS loyalty_number, cal.year, cal.month,
         COALESCE(s.total_flights, 0)::DOUBLE AS total_flights,
         COALESCE(s.flights_booked, 0)::DOUBLE AS flights_booked,
         COALESCE(s.companion_flights, 0)::DOUBLE AS companion_flights,
         COALESCE(s.distance, 0)::DOUBLE AS distance,
         COALESCE(s.points_accumulated, 0)::DOUBLE AS points_accumulated,
         COALESCE(s.points_redeemed, 0)::DOUBLE AS points_redeemed,
         COALESCE(s.dollar_points_redeemed, 0)::DOUBLE AS dollar_points_redeemed
  FROM (SELECT DISTINCT loyalty_number FROM sparse) k CROSS JOIN cal
  LEFT JOIN sparse s ON s.loyalty_number = k.loyalty_number AND s.year = cal.year AND s.month = cal.month)"""

LOYALTY_CTE = """
first_last AS (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
               FROM orders GROUP BY o_custkey),
loyalty AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS loyalty_number,
         CASE WHEN r.r_name = 'AMERICA' THEN 'United States' ELSE 'Canada' END AS country,
         n.n_name AS province,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CASE c.c_custkey % 6 WHEN 1 THEN 'High School or Below' WHEN 2 THEN 'College'
              WHEN 3 THEN 'Bachelor' WHEN 4 THEN 'Master' WHEN 5 THEN 'Doctor' END AS education,
         CASE WHEN c.c_custkey % 4 = 0 THEN NULL
              ELSE CAST((c.c_custkey * 7919) % 100000 + 15000 AS DOUBLE) END AS salary,
         CASE c.c_custkey % 3 WHEN 0 THEN 'Divorced' WHEN 1 THEN 'Married' ELSE 'Single' END AS marital_status,
         CASE WHEN c.c_custkey % 10 < 5 THEN 'Star' WHEN c.c_custkey % 10 < 8 THEN 'Nova' ELSE 'Aurora' END AS loyalty_card,
         CAST(c.c_acctbal AS DOUBLE) AS clv,
         CASE WHEN c.c_custkey % 20 = 0 THEN '2018 Promotion' ELSE 'Standard' END AS enrollment_type,
         CAST(CASE WHEN c.c_custkey % 20 = 0 THEN 2018 WHEN fl.first_order IS NULL THEN 2017
                   ELSE least(year(fl.first_order) + 18, 2018) END AS INTEGER) AS enrollment_year,
         CAST(CASE WHEN c.c_custkey % 20 = 0 THEN c.c_custkey % 12 + 1 WHEN fl.first_order IS NULL THEN 1
                   ELSE month(fl.first_order) END AS INTEGER) AS enrollment_month,
         CAST(CASE WHEN fl.last_order < TIMESTAMP '2000-07-01' THEN year(fl.last_order) + 18 END AS INTEGER)
           AS cancellation_year
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN first_last fl ON c.c_custkey = fl.o_custkey)"""

FLIGHT_CTE = """
ff_agg AS (
  SELECT loyalty_number,
         SUM(total_flights) AS total_flights_24m,
         AVG(total_flights) AS avg_monthly_flights,
         COALESCE(STDDEV_SAMP(total_flights), 0) AS flight_consistency,
         SUM(flights_booked) AS total_flights_booked,
         SUM(companion_flights) AS companions,
         SUM(distance) AS total_distance_24m,
         SUM(points_accumulated) AS points_accumulated_24m,
         SUM(points_redeemed) AS points_redeemed_24m,
         SUM(dollar_points_redeemed) AS dollar_points_redeemed_24m,
         AVG(CASE WHEN year = 2017 THEN total_flights END) AS avg_y1,
         AVG(CASE WHEN year = 2018 THEN total_flights END) AS avg_y2,
         COUNT(*) FILTER (WHERE total_flights > 0) AS n_active,
         MAX(CASE WHEN total_flights > 0 THEN CASE WHEN year = 2017 THEN month ELSE month + 12 END END) AS last_flight,
         COUNT(*) FILTER (WHERE points_redeemed > 0) AS n_redeem,
         SUM(CASE WHEN month IN (6, 7, 8, 12) THEN total_flights END) AS peak
  FROM activity WHERE year IN (2017, 2018) GROUP BY loyalty_number),
flight_features AS (
  SELECT loyalty_number, total_flights_24m, avg_monthly_flights, flight_consistency,
         total_flights_booked, total_distance_24m, points_accumulated_24m, points_redeemed_24m,
         dollar_points_redeemed_24m,
         COALESCE(avg_y2, 0) - COALESCE(avg_y1, 0) AS flight_trend_yoy,
         CASE WHEN total_flights_24m > 0 THEN companions / total_flights_24m ELSE 0 END::DOUBLE AS companion_ratio,
         CASE WHEN total_flights_24m > 0 THEN total_distance_24m / total_flights_24m ELSE 0 END::DOUBLE AS avg_distance_per_flight,
         CASE WHEN points_accumulated_24m > 0 THEN least(points_redeemed_24m / points_accumulated_24m, 1.0::DOUBLE)
              ELSE 0 END::DOUBLE AS points_utilization,
         n_active::DOUBLE AS months_active,
         (24.0::DOUBLE - COALESCE(last_flight::DOUBLE, 0.0::DOUBLE)) AS recency_last_flight,
         (n_redeem::DOUBLE / 24.0::DOUBLE) AS redemption_frequency,
         CASE WHEN total_flights_24m > 0 THEN COALESCE(peak, 0) / total_flights_24m ELSE 0 END::DOUBLE AS seasonal_peak_ratio
  FROM ff_agg)"""

LOYALTY_FEATURES_CTE = """
lf0 AS (
  SELECT *,
         CAST(cancellation_year IS NOT NULL AS INTEGER) AS churn,
         CAST((2018 - enrollment_year) * 12 + (12 - enrollment_month) + 12 AS DOUBLE) AS tenure_months,
         CAST(CASE loyalty_card WHEN 'Star' THEN 1 WHEN 'Nova' THEN 2 WHEN 'Aurora' THEN 3 END AS DOUBLE) AS loyalty_tier_numeric,
         CAST(COALESCE(enrollment_type = '2018 Promotion', false) AS INTEGER) AS is_promotion_enrollee,
         CAST(COALESCE(gender = 'Male', false) AS INTEGER) AS gender_encoded,
         CAST(CASE education WHEN 'High School or Below' THEN 1 WHEN 'College' THEN 2 WHEN 'Bachelor' THEN 3
                             WHEN 'Master' THEN 4 WHEN 'Doctor' THEN 5 END AS DOUBLE) AS education_encoded,
         CAST(COALESCE(marital_status = 'Married', false) AS INTEGER) AS marital_married,
         CAST(COALESCE(marital_status = 'Single', false) AS INTEGER) AS marital_single,
         CAST(COALESCE(country = 'United States', false) AS INTEGER) AS country_united_states
  FROM loyalty),
loyalty_features AS (
  SELECT *, CASE WHEN tenure_months > 0 THEN clv / (tenure_months / 12) ELSE 0 END::DOUBLE AS clv_per_year
  FROM lf0)"""

_FLIGHT_COLS = S.FLIGHT_FEATURES

FEATURES_CTE = ",".join([ACTIVITY_CTE, LOYALTY_CTE, FLIGHT_CTE, LOYALTY_FEATURES_CTE]) + """,
ft0 AS (
  SELECT lf.*, """ + ", ".join(f"COALESCE(ff.{c}, 0)::DOUBLE AS {c}" for c in _FLIGHT_COLS) + """
  FROM loyalty_features lf LEFT JOIN flight_features ff ON lf.loyalty_number = ff.loyalty_number),
ft1 AS (
  SELECT *,
         CASE WHEN total_flights_24m > 0 THEN clv / total_flights_24m ELSE 0 END::DOUBLE AS clv_per_flight,
         CASE WHEN salary > 0 THEN total_distance_24m / salary ELSE 0 END::DOUBLE AS distance_per_salary,
         CASE WHEN total_flights_24m > 0 THEN points_accumulated_24m / total_flights_24m ELSE 0 END::DOUBLE AS points_per_flight,
         CASE WHEN clv > 0 THEN total_distance_24m / clv ELSE 0 END::DOUBLE AS miles_per_dollar_clv
  FROM ft0),
sizes1 AS (SELECT churn, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM ft1 GROUP BY churn),
exact1 AS (SELECT churn, ceil(0.15::DOUBLE * total) * n / total AS x, ceil(0.15::DOUBLE * total) AS wanted FROM sizes1),
take1 AS (SELECT churn, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, churn) <= wanted - SUM(floor(x)) OVER () AS INTEGER) AS k
          FROM exact1),
part1 AS (SELECT loyalty_number, churn, row_number() OVER (PARTITION BY churn ORDER BY md5(CAST(loyalty_number AS VARCHAR) || '-42')) <= k AS in_test
          FROM ft1 JOIN take1 USING (churn)),
sizes2 AS (SELECT churn, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM part1 WHERE NOT in_test GROUP BY churn),
exact2 AS (SELECT churn, ceil(0.176::DOUBLE * total) * n / total AS x, ceil(0.176::DOUBLE * total) AS wanted FROM sizes2),
take2 AS (SELECT churn, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, churn) <= wanted - SUM(floor(x)) OVER () AS INTEGER) AS k
          FROM exact2),
part2 AS (SELECT loyalty_number, CASE WHEN in_test THEN 'test' WHEN row_number() OVER (PARTITION BY churn, in_test
            ORDER BY md5(CAST(loyalty_number AS VARCHAR) || '-42-val')) <= k THEN 'validation' ELSE 'train' END AS split
          FROM part1 JOIN take2 USING (churn)),
features AS (SELECT ft1.*, split FROM ft1 JOIN part2 USING (loyalty_number))"""

LOYALTY_COLS = ["loyalty_number", "country", "province", "gender", "education", "salary",
                "marital_status", "loyalty_card", "clv", "enrollment_type", "enrollment_year",
                "enrollment_month", "cancellation_year"]
LF_EXTRA = ["churn", "tenure_months", "loyalty_tier_numeric", "is_promotion_enrollee",
            "gender_encoded", "education_encoded", "marital_married", "marital_single",
            "country_united_states", "clv_per_year"]
DOUBLE_LOYALTY = {"salary", "clv", "tenure_months", "loyalty_tier_numeric", "education_encoded",
                  "clv_per_year", "cancellation_year"}


def _sel(cols, doubles) -> str:
    return ", ".join(f"(round({c}, 6) + 0.0)::DOUBLE AS {c}" if c in doubles else c for c in cols)


def q(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


q("activity_monthly", f"WITH {ACTIVITY_CTE} SELECT * FROM activity")
q("loyalty_history", f"WITH {LOYALTY_CTE} SELECT * REPLACE (CAST(cancellation_year AS DOUBLE) AS cancellation_year) FROM loyalty")
q("flight_features", f"WITH {ACTIVITY_CTE},{FLIGHT_CTE} SELECT loyalty_number, {r6(*_FLIGHT_COLS)} FROM flight_features")
q("loyalty_features", f"WITH {LOYALTY_CTE},{LOYALTY_FEATURES_CTE} SELECT "
  + _sel(LOYALTY_COLS + LF_EXTRA, DOUBLE_LOYALTY) + " FROM loyalty_features")
q("feature_table", f"WITH {FEATURES_CTE} SELECT "
  + _sel(LOYALTY_COLS + LF_EXTRA + _FLIGHT_COLS + S.INTERACTION_FEATURES,
         DOUBLE_LOYALTY | set(_FLIGHT_COLS) | set(S.INTERACTION_FEATURES)) + " FROM features")


def _guard(c: str) -> str:
    return (f"round(CASE WHEN {c} IS NULL OR isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN 0 "
            f"ELSE {c}::DOUBLE END, 6)::DOUBLE AS {c}")


MATRIX_SELECT = "loyalty_number, " + ", ".join(_guard(c) for c in S.FEATURES) + ", churn"
q("model_matrix", f"WITH {FEATURES_CTE} SELECT {MATRIX_SELECT} FROM features")

# ----------------------------------------------------------------- segment reports
q("portfolio_kpis", f"""WITH {FEATURES_CTE},
k AS (SELECT COUNT(*) AS total_customers, SUM(churn)::BIGINT AS churned_customers, AVG(clv) AS avg_clv,
             SUM(clv) AS total_clv, COALESCE(SUM(CASE WHEN churn = 1 THEN clv END), 0) AS churned_clv FROM features)
SELECT total_customers, churned_customers, total_customers - churned_customers AS active_customers,
       round(churned_customers / total_customers * 100, 6)::DOUBLE AS churn_rate,
       round((total_customers - churned_customers) / total_customers * 100, 6)::DOUBLE AS active_pct,
       {r6('avg_clv', 'total_clv', 'churned_clv')} FROM k""")

q("tier_kpis", f"""WITH {FEATURES_CTE},
t(tier) AS (VALUES ('Star'), ('Nova'), ('Aurora')),
g AS (SELECT loyalty_card, COUNT(*) AS n, SUM(churn) AS c FROM features GROUP BY loyalty_card)
SELECT t.tier, COALESCE(g.n, 0)::BIGINT AS customers,
       round(CASE WHEN COALESCE(g.n, 0) > 0 THEN g.c / g.n * 100 ELSE 0 END, 6)::DOUBLE AS churn_rate
FROM t LEFT JOIN g ON g.loyalty_card = t.tier""")


def _churn_by(col: str, alias: str, with_clv: bool = True, extra: str = "") -> str:
    clv = ", AVG(clv) AS avg_clv" if with_clv else ""
    return (f"SELECT {col} AS {alias}, SUM(churn)::BIGINT AS churned, COUNT(churn) AS total, "
            f"AVG(churn) * 100 AS churn_rate{clv}{extra} FROM features WHERE {col} IS NOT NULL GROUP BY {col}")


q("churn_by_tier", f"""WITH {FEATURES_CTE}, g AS ({_churn_by('loyalty_card', 'tier', True, ', AVG(total_flights_24m) AS avg_flights')})
SELECT tier, churned, total, {r6('churn_rate', 'avg_clv', 'avg_flights')}, total - churned AS active FROM g""")

q("churn_by_enrollment", f"""WITH {FEATURES_CTE}, g AS ({_churn_by('enrollment_type', 'enrollment_type')}),
s AS (SELECT SUM(churned) AS all_churned FROM g)
SELECT enrollment_type, churned, total, {r6('churn_rate', 'avg_clv')},
       round(CASE WHEN all_churned > 0 THEN churned / all_churned * 100 END, 6)::DOUBLE AS churn_share,
       CASE WHEN churn_rate > 20 THEN 'High' WHEN churn_rate > 15 THEN 'Elevated' ELSE 'Normal' END AS rate_band
FROM g, s""")

q("churn_by_gender", f"""WITH {FEATURES_CTE}, g AS ({_churn_by('gender', 'gender', False)})
SELECT gender, churned, total, {r6('churn_rate')} FROM g""")

q("churn_by_marital", f"""WITH {FEATURES_CTE}, g AS ({_churn_by('marital_status', 'marital_status', False)})
SELECT marital_status, churned, total, {r6('churn_rate')} FROM g""")

q("churn_by_education", f"""WITH {FEATURES_CTE}, g AS ({_churn_by('education', 'education', False)})
SELECT education, churned, total, {r6('churn_rate')},
       CAST(CASE education WHEN 'High School or Below' THEN 0 WHEN 'College' THEN 1 WHEN 'Bachelor' THEN 2
                           WHEN 'Master' THEN 3 WHEN 'Doctor' THEN 4 ELSE 99 END AS INTEGER) AS education_rank
FROM g""")

q("churn_by_province_top10", f"""WITH {FEATURES_CTE},
g AS (SELECT province, SUM(churn)::BIGINT AS churned, COUNT(churn) AS total, AVG(churn) * 100 AS churn_rate
      FROM features WHERE country = 'Canada' AND province IS NOT NULL GROUP BY province),
top AS (SELECT * FROM g ORDER BY total DESC, province ASC LIMIT 10)
SELECT province, churned, total, {r6('churn_rate')},
       CASE WHEN churn_rate > 18 THEN 'High' WHEN churn_rate > 15 THEN 'Elevated' ELSE 'Normal' END AS rate_band
FROM top""")

_DIMS = [("tier", "loyalty_card"), ("enrollment_type", "enrollment_type"), ("gender", "gender"),
         ("education", "education"), ("marital_status", "marital_status"), ("province", "province")]
_dim_case = "CASE " + " ".join(f"WHEN GROUPING({c}) = 0 THEN '{n}'" for n, c in _DIMS) + " END"
_seg_case = "CASE " + " ".join(f"WHEN GROUPING({c}) = 0 THEN CAST({c} AS VARCHAR)" for n, c in _DIMS) + " END"
q("segment_grouping_sets", f"""WITH {FEATURES_CTE},
g AS (SELECT {_dim_case} AS dimension, {_seg_case} AS segment, SUM(churn)::BIGINT AS churned,
             COUNT(churn) AS total, AVG(churn) * 100 AS churn_rate, AVG(clv) AS avg_clv,
             AVG(total_flights_24m) AS avg_flights
      FROM features GROUP BY GROUPING SETS ({', '.join(f'({c})' for _, c in _DIMS)}))
SELECT dimension, segment, churned, total, {r6('churn_rate', 'avg_clv', 'avg_flights')}
FROM g WHERE segment IS NOT NULL""")

q("segment_filtered_kpis", f"""WITH {FEATURES_CTE},
b AS (SELECT CAST(trunc(min(salary)) AS BIGINT) AS s_lo, CAST(trunc(max(salary)) AS BIGINT) AS s_hi,
             CAST(trunc(min(tenure_months)) AS BIGINT) AS t_lo, CAST(trunc(max(tenure_months)) AS BIGINT) AS t_hi
      FROM features),
x AS (SELECT f.*, COALESCE(loyalty_card IN ('Star', 'Nova') AND salary >= s_lo AND salary <= s_hi
                           AND tenure_months >= t_lo AND tenure_months <= t_hi, false) AS keep
      FROM features f, b)
SELECT COUNT(*) FILTER (WHERE keep) AS filtered_customers, COUNT(*) AS total_customers,
       round(AVG(CASE WHEN keep THEN churn END) * 100, 6)::DOUBLE AS churn_rate,
       round(AVG(CASE WHEN keep THEN clv END), 6)::DOUBLE AS avg_clv,
       round(AVG(CASE WHEN keep THEN total_flights_24m END), 6)::DOUBLE AS avg_flights
FROM x""")

q("segment_filtered_provinces", f"""WITH {FEATURES_CTE},
b AS (SELECT CAST(trunc(min(salary)) AS BIGINT) AS s_lo, CAST(trunc(max(salary)) AS BIGINT) AS s_hi,
             CAST(trunc(min(tenure_months)) AS BIGINT) AS t_lo, CAST(trunc(max(tenure_months)) AS BIGINT) AS t_hi
      FROM features),
x AS (SELECT f.*, COALESCE(province IN ('NATION_0', 'NATION_3') AND salary >= s_lo AND salary <= s_hi
                           AND tenure_months >= t_lo AND tenure_months <= t_hi, false) AS keep
      FROM features f, b)
SELECT COUNT(*) FILTER (WHERE keep) AS filtered_customers, COUNT(*) AS total_customers,
       round(AVG(CASE WHEN keep THEN churn END) * 100, 6)::DOUBLE AS churn_rate,
       round(AVG(CASE WHEN keep THEN clv END), 6)::DOUBLE AS avg_clv,
       round(AVG(CASE WHEN keep THEN total_flights_24m END), 6)::DOUBLE AS avg_flights
FROM x""")

q("balanced_sample", f"""WITH {FEATURES_CTE},
r AS (SELECT loyalty_number, churn, row_number() OVER (PARTITION BY churn
             ORDER BY md5(CAST(loyalty_number AS VARCHAR) || '-42')) AS n FROM features)
SELECT loyalty_number, churn FROM r WHERE n <= 100""")

q("filter_domains", f"""WITH {FEATURES_CTE}
SELECT string_agg(DISTINCT loyalty_card, '|' ORDER BY loyalty_card) AS tiers,
       string_agg(DISTINCT enrollment_type, '|' ORDER BY enrollment_type) AS enrollment_types,
       string_agg(DISTINCT province, '|' ORDER BY province) AS provinces,
       CAST(trunc(min(salary)) AS BIGINT) AS salary_min, CAST(trunc(max(salary)) AS BIGINT) AS salary_max,
       CAST(trunc(min(tenure_months)) AS BIGINT) AS tenure_min, CAST(trunc(max(tenure_months)) AS BIGINT) AS tenure_max,
       min(loyalty_number) AS key_min, max(loyalty_number) AS key_max
FROM features""")

q("filter_values", f"""WITH {FEATURES_CTE}
SELECT DISTINCT 'tier' AS dimension, loyalty_card AS value FROM features WHERE loyalty_card IS NOT NULL
UNION ALL SELECT DISTINCT 'enrollment_type', enrollment_type FROM features WHERE enrollment_type IS NOT NULL
UNION ALL SELECT DISTINCT 'province', province FROM features WHERE province IS NOT NULL
UNION ALL SELECT 'salary_min', CAST(trunc(min(salary)) AS BIGINT)::VARCHAR FROM features UNION ALL SELECT 'salary_max', CAST(trunc(max(salary)) AS BIGINT)::VARCHAR FROM features
UNION ALL SELECT 'tenure_months_min', CAST(trunc(min(tenure_months)) AS BIGINT)::VARCHAR FROM features
UNION ALL SELECT 'tenure_months_max', CAST(trunc(max(tenure_months)) AS BIGINT)::VARCHAR FROM features
UNION ALL SELECT 'loyalty_number_min', min(loyalty_number)::VARCHAR FROM features UNION ALL SELECT 'loyalty_number_max', max(loyalty_number)::VARCHAR FROM features""")

q("one_hot_levels", f"""WITH {LOYALTY_CTE}
SELECT loyalty_number, marital_status, CAST(marital_status = 'Married' AS INTEGER) AS "marital_Married",
       CAST(marital_status = 'Single' AS INTEGER) AS "marital_Single" FROM loyalty""")

q("monthly_trend", f"""WITH {FEATURES_CTE},
g AS (SELECT printf('%d-%02d', a.year, a.month) AS month_year, f.churn, AVG(a.total_flights) AS avg_flights
      FROM activity a JOIN features f ON a.loyalty_number = f.loyalty_number
      WHERE f.churn IS NOT NULL GROUP BY 1, 2),
ann AS (SELECT MAX(CASE WHEN churn = 0 THEN avg_flights END) * 0.9 AS annotation_y FROM g)
SELECT month_year, churn, {r6('avg_flights')},
       CASE WHEN churn = 0 THEN 'Active' WHEN churn = 1 THEN 'Churned' END AS status,
       round(annotation_y, 6)::DOUBLE AS annotation_y
FROM g, ann""")


def hist_sql(value: str, bins: int, source: str = "features", by_status: bool = True,
             domain: tuple[float, float] | None = None, ctes: str = FEATURES_CTE,
             marker: float | None = None) -> str:
    if domain is None:
        bounds = f"b AS (SELECT min({value}::DOUBLE) AS lo, max({value}::DOUBLE) AS hi FROM {source})"
    else:
        bounds = f"b AS (SELECT {float(domain[0])}::DOUBLE AS lo, {float(domain[1])}::DOUBLE AS hi)"
    status = ("CASE WHEN churn = 0 THEN 'Active' WHEN churn = 1 THEN 'Churned' END AS status, "
              if by_status else "")
    group = "status, bin" if by_status else "bin"
    part = "PARTITION BY status" if by_status else ""
    mark = f", '{float(marker)!r}'::DOUBLE AS marker" if marker is not None else ""
    return f"""WITH {ctes}, {bounds},
x AS (SELECT {status}
             CAST(greatest(CASE WHEN hi - lo > 0
                  THEN least(floor(({value}::DOUBLE - lo) / (hi - lo) * {bins}) + 1, {bins}) ELSE 1 END, 1) AS BIGINT) AS bin,
             lo, hi, {value}::DOUBLE AS v
      FROM {source}, b WHERE {value} IS NOT NULL),
g AS (SELECT {group}, min(lo) AS lo, min(hi) AS hi, COUNT(*) AS count, SUM(v) AS s FROM x GROUP BY {group})
SELECT {group}, (round(lo + (bin - 1) * (hi - lo) / {bins}, 6) + 0.0)::DOUBLE AS bin_lo,
       (round(lo + bin * (hi - lo) / {bins}, 6) + 0.0)::DOUBLE AS bin_hi, count,
       (round(SUM(s) OVER ({part}) / SUM(count) OVER ({part}), 6) + 0.0)::DOUBLE AS mean{mark}
FROM g"""


q("hist_flights", hist_sql("total_flights_24m", 30))
q("hist_trend", hist_sql("flight_trend_yoy", 30))
q("hist_utilization", hist_sql("points_utilization", 20))
q("hist_recency", hist_sql("recency_last_flight", 20))


def all_oracle() -> dict[str, str]:
    from . import oracle_io, oracle_models, oracle_scoring  # noqa: F401
    return dict(ORACLE)
