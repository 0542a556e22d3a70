"""Oracle SQL for the I/O, export, report and customer-view plans."""

from __future__ import annotations

from .. import schemas as S
from .oracle import ACTIVITY_CTE, FEATURES_CTE, LOYALTY_CTE, q
from .oracle_models import ENSEMBLE_CTE, _tuned
from .oracle_scoring import ACTION_ITEMS, ATTR_CTE, NO_ACTION, R6, SCORED_CTE, TOP_CTE, _g, _margin, _text

q("activity_csv_round_trip", f"WITH {ACTIVITY_CTE} SELECT * FROM activity")

q("scoring_report", f"""WITH {SCORED_CTE},
k AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_level = 'High') AS high,
             COUNT(*) FILTER (WHERE risk_level = 'Medium') AS medium,
             COUNT(*) FILTER (WHERE risk_level = 'Low') AS low,
             AVG(churn_probability) AS mean_p, median(churn_probability) AS median_p FROM scored)
SELECT concat_ws(chr(10),
  'Batch Prediction Summary Report',
  '================================',
  '',
  'Total Customers Processed: ' || format('{{:,}}', total),
  '',
  'Risk Distribution:',
  '- High Risk (>60%): ' || format('{{:,}}', high) || ' (' || format('{{:.1f}}', high / total * 100) || '%)',
  '- Medium Risk (30-60%): ' || format('{{:,}}', medium) || ' (' || format('{{:.1f}}', medium / total * 100) || '%)',
  '- Low Risk (<30%): ' || format('{{:,}}', low) || ' (' || format('{{:.1f}}', low / total * 100) || '%)',
  '',
  'Average Churn Probability: ' || format('{{:.1f}}', mean_p * 100.0::DOUBLE) || '%',
  'Median Churn Probability: ' || format('{{:.1f}}', median_p * 100.0::DOUBLE) || '%',
  '',
  'Threshold Used: ' || format('{{:.2f}}', 0.5::DOUBLE),
  '') AS report
FROM k""")

q("action_list_export", f"""WITH {SCORED_CTE},
a AS (SELECT loyalty_number, clv, churn_probability, list_filter([{ACTION_ITEMS}], lambda x: x IS NOT NULL) AS items
      FROM scored WHERE risk_level = 'High')
SELECT loyalty_number AS "Customer ID", '$' || format('{{:,.2f}}', clv) AS "CLV",
       format('{{:.1f}}', churn_probability * 100.0::DOUBLE) || '%' AS "Churn Risk",
       CASE WHEN len(items) > 0 THEN array_to_string(items[1:2], '; ') ELSE '{NO_ACTION}' END
         AS "Recommended Actions"
FROM a""")

q("customer_view", f"""WITH {SCORED_CTE}
SELECT loyalty_number, loyalty_card AS tier, (round(clv, 6) + 0.0)::DOUBLE AS clv,
       (round(tenure_months, 6) + 0.0)::DOUBLE AS tenure_months,
       CASE WHEN is_promotion_enrollee = 1 THEN 'Promotion' ELSE 'Standard' END AS enrollment,
       (round(churn_probability, 6) + 0.0)::DOUBLE AS churn_probability, risk_level, predicted_churn,
       CASE WHEN churn = 0 THEN 'Active' WHEN churn = 1 THEN 'Churned' END AS actual_outcome
FROM scored WHERE loyalty_number = (SELECT min(loyalty_number) FROM scored)""")

q("showcase_ids", f"""WITH {FEATURES_CTE},
top AS (SELECT loyalty_number FROM features ORDER BY clv DESC, loyalty_number ASC LIMIT 5),
ch AS (SELECT loyalty_number FROM features WHERE churn = 1
       ORDER BY md5(CAST(loyalty_number AS VARCHAR) || '-42') LIMIT 5)
SELECT DISTINCT loyalty_number FROM (SELECT * FROM top UNION ALL SELECT * FROM ch)""")

q("action_list_preview", f"""WITH {SCORED_CTE},
a AS (SELECT loyalty_number, clv, churn_probability, list_filter([{ACTION_ITEMS}], lambda x: x IS NOT NULL) AS items
      FROM scored WHERE risk_level = 'High' ORDER BY churn_probability DESC, loyalty_number LIMIT 10)
SELECT loyalty_number AS "Customer ID", '$' || format('{{:,.2f}}', clv) AS "CLV",
       format('{{:.1f}}', churn_probability * 100.0::DOUBLE) || '%' AS "Churn Risk",
       CASE WHEN len(items) > 0 THEN array_to_string(items[1:2], '; ') ELSE '{NO_ACTION}' END
         AS "Recommended Actions"
FROM a""")

q("loyalty_csv_round_trip", f"""WITH {LOYALTY_CTE}
SELECT * REPLACE (CAST(cancellation_year AS DOUBLE) AS cancellation_year) FROM loyalty""")

_exported = """SELECT loyalty_number, (round(clv, 6) + 0.0)::DOUBLE AS clv,
       (round(churn_probability, 6) + 0.0)::DOUBLE AS churn_probability, risk_level, predicted_churn FROM scored"""
q("scored_export_round_trip", f"WITH {SCORED_CTE} {_exported}")
q("high_risk_export_round_trip", f"WITH {SCORED_CTE} {_exported} WHERE churn_probability >= 0.6")

q("attribution_store_round_trip", f"""WITH {ATTR_CTE}
SELECT loyalty_number, (round(MIN(base_value), 6) + 0.0)::DOUBLE AS base_value,
       (round(MIN(base_value) + SUM(shap_value), 6) + 0.0)::DOUBLE AS margin
FROM attr, base GROUP BY loyalty_number""")

_ft = ", ".join(f"({_g(f)}) AS {f}" for f in S.FEATURES)
_fr = ", ".join(R6(f, f) for f in S.FEATURES)
q("test_set_round_trip", f"""WITH {FEATURES_CTE}, m AS (SELECT loyalty_number, {_ft}, churn FROM features WHERE split = 'test')
SELECT loyalty_number, {_fr}, churn FROM m""")

_names = ", ".join(f"('feature_names', '{f}', {i}::DOUBLE)" for i, f in enumerate(S.FEATURES))
q("metadata_round_trip", f"""WITH {ENSEMBLE_CTE},
linear AS (SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_margin()}))), 6) AS churn_probability FROM mx),
{_tuned('best', 'scored')}, {_tuned('lbest', 'linear')}
SELECT 'threshold' AS document, 'gbt' AS name, threshold AS value FROM best UNION ALL SELECT 'threshold', 'lr', threshold FROM lbest
UNION ALL SELECT * FROM (VALUES ('threshold', 'other', 0.5::DOUBLE), ('parameters', 'n_estimators', 300), ('parameters', 'max_depth', 3),
  ('parameters', 'learning_rate', 0.1), ('parameters', 'num_leaves', 15), ('parameters', 'min_child_samples', 50), ('parameters', 'subsample', 0.7),
  ('parameters', 'colsample_bytree', 0.7), ('parameters', 'reg_alpha', 1.0), ('parameters', 'reg_lambda', 0.1), {_names})""")

# the template holds the key and the first 20 inputs; the ensemble's other inputs are 0
_kept = S.FEATURES[:20]
_blank = ", ".join(f"0.0::DOUBLE AS {f}" for f in S.FEATURES if f not in _kept)
q("partial_upload_scores", "WITH " + ENSEMBLE_CTE.replace("mx AS (SELECT * FROM features)",
  f"whole AS (SELECT * FROM features), mx AS (SELECT loyalty_number, churn, split, {', '.join(_kept)}, {_blank} FROM whole)").replace(
  "FROM features", "FROM mx").replace("whole AS (SELECT * FROM mx)", "whole AS (SELECT * FROM features)") + f"""
SELECT loyalty_number, {R6('churn_probability', 'churn_probability')}, CAST(11 AS INTEGER) AS n_defaulted,
  'gender_encoded,education_encoded,salary,clv,marital_married,marital_single,country_united_states,clv_per_flight,distance_per_salary,points_per_flight,miles_per_dollar_clv' AS defaulted
FROM scored""")

q("rejected_cells", f"""WITH {FEATURES_CTE}
SELECT CAST(loyalty_number AS VARCHAR) AS loyalty_number, 'salary' AS column, 'n/a' AS raw, 'malformed' AS reason FROM features WHERE loyalty_number % 50 = 7
UNION ALL SELECT CAST(loyalty_number AS VARCHAR), 'clv', '$' || CAST(CAST(floor(clv) AS BIGINT) AS VARCHAR), 'malformed' FROM features WHERE loyalty_number % 40 = 3
UNION ALL SELECT NULL, 'comment', NULL, 'unknown column'""")

q("riskiest_customer_report", f"""WITH {TOP_CTE},
sc AS (SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_margin()}))), 6) AS churn_probability FROM features),
one AS (SELECT *, CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level
        FROM sc ORDER BY churn_probability DESC, loyalty_number LIMIT 1),
mine AS (SELECT ranked.* FROM ranked JOIN one USING (loyalty_number)),
bars AS (SELECT least(rank, 10) AS position, SUM(shap_value) AS v, MIN(feature) AS f, COUNT(*) AS n FROM mine GROUP BY least(rank, 10)),
rules AS (
  SELECT 0 AS prio, -1 AS ord, 'Critical' AS priority, 'Priority outreach - Assign personal account manager (CLV: $' || format('{{:,.0f}}', clv) || ')' AS action,
         '$100/customer' AS cost, 'High-value customer at risk' AS reason FROM one WHERE clv > 5000 AND churn_probability > 0.5
  UNION ALL SELECT 1, 0, 'High', 'Targeted fare discount (15% off next booking)', '$50/customer', 'Declining flight activity' FROM one WHERE flight_trend_yoy < 0
  UNION ALL SELECT 2, 1, 'Medium', 'Points expiry warning + bonus redemption catalog', '$10/customer', 'Low points engagement' FROM one WHERE points_utilization < 0.3
  UNION ALL SELECT 1, 2, 'High', 'Welcome series + personal onboarding call', '$25/customer', 'Promotion enrollee (high churn segment)' FROM one WHERE is_promotion_enrollee = 1
  UNION ALL SELECT 2, 3, 'Medium', 'Family/group booking incentive (2-for-1 companion)', '$30/customer', 'Low companion travel' FROM one WHERE companion_ratio < 0.2
  UNION ALL SELECT 2, 4, 'Medium', 'Win-back campaign with exclusive offer', '$15/customer', 'Lapsed traveler' FROM one WHERE recency_last_flight > 6
  UNION ALL SELECT 3, 5, 'Low', 'Points bonus multiplier for next redemption', '$20/customer', 'Rare points redemption' FROM one WHERE redemption_frequency < 0.1),
picked AS (SELECT *, row_number() OVER (ORDER BY prio, ord) AS rank FROM rules),
parts AS (
  SELECT 'profile' AS section, 1 AS position, 'tier' AS label, loyalty_card AS text, NULL::DOUBLE AS value FROM one
  UNION ALL SELECT 'profile', 2, 'clv', NULL, clv FROM one
  UNION ALL SELECT 'profile', 3, 'tenure_months', NULL, tenure_months FROM one
  UNION ALL SELECT 'profile', 4, 'enrollment', CASE WHEN is_promotion_enrollee = 1 THEN 'Promotion' ELSE 'Standard' END, NULL FROM one
  UNION ALL SELECT 'profile', 5, 'churn_probability', risk_level, churn_probability FROM one
  UNION ALL SELECT 'profile', 6, 'predicted_churn', NULL, CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END FROM one
  UNION ALL SELECT 'profile', 7, 'actual_outcome', CASE WHEN churn = 1 THEN 'Churned' ELSE 'Active' END, NULL FROM one
  UNION ALL SELECT 'factor', rank, feature, {_text}, shap_value FROM mine WHERE rank <= 5
  UNION ALL SELECT 'waterfall', position, CASE WHEN position <= 9 THEN f ELSE n::VARCHAR || ' other features' END, NULL,
    (SELECT base_value FROM base) + SUM(v) OVER (ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM bars
  UNION ALL SELECT 'recommendation', rank, priority, action || ' | ' || cost || ' | ' || reason, NULL FROM picked WHERE rank <= 5)
SELECT (SELECT loyalty_number FROM one) AS loyalty_number, section, CAST(position AS INTEGER) AS position, label, text, {R6('value', 'value')} FROM parts""")
