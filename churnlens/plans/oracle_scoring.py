"""Oracle SQL for the score-consumer plans (fixture score, split, evaluation,
linear attribution, retention)."""

from __future__ import annotations

from .. import schemas as S
from .oracle import FEATURES_CTE, hist_sql, q


# The rules, weights and texts are written out here too, so that a wrong constant of the engine shows.
WEIGHTS = {"recency_last_flight": "0.15", "flight_trend_yoy": "-0.8", "total_flights_24m": "-0.05", "points_utilization": "-0.5",
           "is_promotion_enrollee": "0.3"}
ACTIONS = [("flight_trend_yoy < 0", "Targeted fare discount"), ("points_utilization < 0.3", "Points engagement campaign"),
           ("is_promotion_enrollee = 1", "Personal onboarding call"), ("recency_last_flight > 6", "Win-back campaign")]
NO_ACTION = "General retention outreach"
RECOMMENDED = [
    ("flight_trend_yoy < 0", 1, "High", "Targeted fare discount (15% off next booking)", "$50/customer", "Declining flight activity"),
    ("points_utilization < 0.3", 2, "Medium", "Points expiry warning + bonus redemption catalog", "$10/customer", "Low points engagement"),
    ("is_promotion_enrollee = 1", 1, "High", "Welcome series + personal onboarding call", "$25/customer",
     "Promotion enrollee (high churn segment)"),
    ("companion_ratio < 0.2", 2, "Medium", "Family/group booking incentive (2-for-1 companion)", "$30/customer", "Low companion travel"),
    ("recency_last_flight > 6", 2, "Medium", "Win-back campaign with exclusive offer", "$15/customer", "Lapsed traveler"),
    ("redemption_frequency < 0.1", 3, "Low", "Points bonus multiplier for next redemption", "$20/customer", "Rare points redemption")]
STRATEGIES = [
    ("Declining Flights", "Targeted fare discount (15% off)", "High", 50, 2100, "flight_trend_yoy < 0"),
    ("Low Points Utilization", "Points expiry warning + bonus catalog", "Medium", 10, 800, "points_utilization < 0.3"),
    ("Promotion Enrollee", "Welcome series + onboarding call", "High", 25, 1500, "is_promotion_enrollee = 1"),
    ("Low Companion Travel", "Family/group booking incentive", "Medium", 30, 950, "companion_ratio < 0.2"),
    ("Lapsed Traveler", "Win-back campaign with exclusive offer", "Low", 15, 400, "recency_last_flight > 6")]


def R6(expr: str, alias: str) -> str:
    return f"(round({expr}, 6) + 0.0)::DOUBLE AS {alias}"


def _g(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN 0 ELSE {c}::DOUBLE END)"


def _margin() -> str:
    return " + ".join(f"('{w}'::DOUBLE * {_g(f)})" for f, w in WEIGHTS.items()) + " + '-1.0'::DOUBLE"


SCORED_CTE = FEATURES_CTE + f""",
sc0 AS (SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_margin()}))), 6) AS churn_probability FROM features),
scored AS (SELECT *,
                  CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.3 THEN 'Medium'
                       ELSE 'Low' END AS risk_level,
                  CAST(churn_probability >= 0.5 AS INTEGER) AS predicted_churn
           FROM sc0)"""

q("fixture_scores", f"""WITH {SCORED_CTE}
SELECT loyalty_number, churn, {R6('churn_probability', 'churn_probability')}, risk_level, predicted_churn FROM scored""")

q("risk_bands", f"""WITH {SCORED_CTE},
b(risk_level, o) AS (VALUES ('High', 0), ('Medium', 1), ('Low', 2)),
n AS (SELECT COUNT(*) AS total FROM scored),
g AS (SELECT risk_level, COUNT(*) AS c FROM scored GROUP BY risk_level)
SELECT b.risk_level, COALESCE(g.c, 0)::BIGINT AS customers,
       {R6('CASE WHEN n.total > 0 THEN COALESCE(g.c, 0) / n.total * 100 ELSE 0 END', 'pct')}
FROM b CROSS JOIN n LEFT JOIN g ON g.risk_level = b.risk_level""")

q("high_risk_list", f"""WITH {SCORED_CTE}
SELECT loyalty_number, {R6('churn_probability', 'churn_probability')}, risk_level FROM scored
WHERE churn_probability >= 0.6""")

q("top20_risk", f"""WITH {SCORED_CTE}
SELECT loyalty_number, loyalty_card, {R6('clv', 'clv')}, {R6('churn_probability', 'churn_probability')}, risk_level
FROM scored ORDER BY churn_probability DESC, loyalty_number ASC LIMIT 20""")

q("risk_tier_summary", f"""WITH {SCORED_CTE}
SELECT CASE WHEN GROUPING(risk_level) = 1 THEN 'All' ELSE risk_level END AS risk_level,
       COUNT(*) AS customers, {R6('SUM(clv)', 'total_clv')}, {R6('AVG(churn_probability)', 'avg_probability')}
FROM scored GROUP BY ROLLUP (risk_level)""")

q("scoring_summary", f"""WITH {SCORED_CTE},
k AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_level = 'High') AS high,
             COUNT(*) FILTER (WHERE risk_level = 'Medium') AS medium,
             COUNT(*) FILTER (WHERE risk_level = 'Low') AS low,
             AVG(churn_probability) AS mean_probability, median(churn_probability) AS median_probability
      FROM scored)
SELECT total, high, medium, low, {R6('high / total * 100', 'high_pct')}, {R6('medium / total * 100', 'medium_pct')},
       {R6('low / total * 100', 'low_pct')}, {R6('mean_probability', 'mean_probability')},
       {R6('median_probability', 'median_probability')}, 0.5::DOUBLE AS threshold
FROM k""")

_seg_rows = " UNION ALL ".join(
    f"SELECT '{name}' AS segment, COUNT(*) FILTER (WHERE risk_level IN ({bands})) AS target_count, "
    f"AVG(CASE WHEN risk_level IN ({bands}) THEN clv END) AS avg_clv FROM scored"
    for name, bands in [("High Risk Only", "'High'"), ("High + Medium Risk", "'High', 'Medium'"), ("All At-Risk Customers", "'High', 'Medium'")])
q("roi_grid", f"""WITH {SCORED_CTE},
st AS ({_seg_rows}),
grid AS (SELECT st.segment, CAST(c.cost AS INTEGER) AS cost_per_customer, CAST(p.pct AS INTEGER) AS success_pct,
                st.target_count, st.avg_clv
         FROM st, range(10, 201, 10) c(cost), range(5, 51, 5) p(pct)),
g2 AS (SELECT *, CAST(target_count * cost_per_customer AS BIGINT) AS total_cost,
              CAST(trunc(target_count * (success_pct::DOUBLE / 100.0::DOUBLE)) AS BIGINT) AS customers_saved
       FROM grid),
g3 AS (SELECT *, customers_saved * avg_clv AS clv_saved FROM g2)
SELECT segment, cost_per_customer, success_pct, target_count, {R6('avg_clv', 'avg_clv')}, total_cost, customers_saved,
       {R6('clv_saved', 'clv_saved')},
       {R6('CASE WHEN total_cost > 0 THEN (clv_saved - total_cost) / total_cost * 100 ELSE 0 END', 'roi_pct')},
       {R6('CASE WHEN total_cost > 0 THEN clv_saved / total_cost ELSE 0 END', 'roi_multiple')}
FROM g3""")


ACTION_ITEMS = ", ".join(f"CASE WHEN COALESCE({cond}, false) THEN '{text}' END" for cond, text in ACTIONS)
q("action_list", f"""WITH {SCORED_CTE},
a AS (SELECT loyalty_number, clv, churn_probability,
             list_filter([{ACTION_ITEMS}], lambda x: x IS NOT NULL) AS items
      FROM scored WHERE risk_level = 'High')
SELECT loyalty_number AS customer_id, {R6('clv', 'clv')}, {R6('churn_probability', 'churn_probability')},
       CASE WHEN len(items) > 0 THEN array_to_string(items[1:2], '; ') ELSE '{NO_ACTION}' END
         AS recommended_actions
FROM a""")

_rule_rows = ["""SELECT loyalty_number, 0 AS prio, -1 AS ord, 'Critical' AS priority,
       'Priority outreach - Assign personal account manager (CLV: $' || format('{:,.0f}', clv) || ')' AS action,
       '$100/customer' AS cost, 'High-value customer at risk' AS reason
FROM scored WHERE COALESCE(clv > 5000 AND churn_probability > 0.5, false)"""]
for i, (cond, prio, name, action, cost, reason) in enumerate(RECOMMENDED):
    _rule_rows.append(f"""SELECT loyalty_number, {prio} AS prio, {i} AS ord, '{name}' AS priority,
       '{action}' AS action, '{cost}' AS cost, '{reason}' AS reason FROM scored WHERE COALESCE({cond}, false)""")
q("recommendations", f"""WITH {SCORED_CTE},
r AS ({' UNION ALL '.join(_rule_rows)}),
k AS (SELECT *, row_number() OVER (PARTITION BY loyalty_number ORDER BY prio, ord) AS rank FROM r)
SELECT loyalty_number, CAST(rank AS INTEGER) AS rank, priority, action, cost, reason FROM k WHERE rank <= 5""")

_strat_dim = ", ".join(f"('{d}', '{a}', '{p}', {c}, {s}, '{cond.replace(' = ', ' == ')}', {i})"
                       for i, (d, a, p, c, s, cond) in enumerate(STRATEGIES))
_strat_stats = " UNION ALL ".join(
    f"SELECT {i} AS i, COUNT(*) FILTER (WHERE COALESCE({cond}, false)) AS customers, "
    f"COUNT(*) FILTER (WHERE COALESCE({cond}, false) AND risk_level = 'High') AS high_risk_customers, "
    f"COALESCE(SUM(CASE WHEN COALESCE({cond}, false) THEN clv END), 0) AS total_clv FROM scored"
    for i, (_, _, _, _, _, cond) in enumerate(STRATEGIES))
q("strategy_impact", f"""WITH {SCORED_CTE},
dim(driver, action, priority, cost_per_customer, est_save_per_customer, target_segment, i) AS (VALUES {_strat_dim}),
st AS ({_strat_stats})
SELECT driver, action, priority, CAST(cost_per_customer AS INTEGER) AS cost_per_customer,
       CAST(est_save_per_customer AS INTEGER) AS est_save_per_customer, target_segment,
       customers, high_risk_customers, {R6('total_clv', 'total_clv')},
       CAST(customers * cost_per_customer AS BIGINT) AS campaign_cost,
       CAST(customers * est_save_per_customer AS BIGINT) AS est_total_save,
       CAST(customers * est_save_per_customer - customers * cost_per_customer AS BIGINT) AS net_saving
FROM dim JOIN st USING (i)""")

q("hist_probability", hist_sql("churn_probability", 30, source="scored", by_status=False,
                               domain=(0.0, 1.0), ctes=SCORED_CTE, marker=0.5))

# ----------------------------------------------------------------- split / evaluation
q("split_assignment", f"""WITH {FEATURES_CTE} SELECT loyalty_number, churn, split FROM features""")

q("class_weights", f"""WITH {FEATURES_CTE},
c AS (SELECT COUNT(*) FILTER (WHERE churn = 0) AS n_neg, COUNT(*) FILTER (WHERE churn = 1) AS n_pos
      FROM features WHERE split = 'train'),
c2 AS (SELECT *, greatest(CAST(trunc(0.4::DOUBLE * n_neg - n_pos) AS BIGINT), 0) AS synthetic_rows FROM c)
SELECT n_neg, n_pos, synthetic_rows, n_pos + synthetic_rows AS n_pos_resampled,
       {R6('CASE WHEN n_pos + synthetic_rows > 0 THEN n_neg / (n_pos + synthetic_rows) END', 'scale_pos_weight')}
FROM c2""")


def _curve_cte(split: str, name: str, source: str = "scored") -> str:
    return f"""{name}_c AS (SELECT churn_probability AS threshold, COUNT(*) FILTER (WHERE churn = 1) AS pos,
                     COUNT(*) FILTER (WHERE churn = 0) AS neg FROM {source} WHERE split = '{split}' GROUP BY 1),
{name}_t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM {name}_c),
{name} AS (SELECT threshold, pos, neg,
                  SUM(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                  SUM(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                  P, N
           FROM {name}_c, {name}_t)"""


BEST_CTE = _curve_cte("validation", "vcurve") + """,
vf AS (SELECT threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM vcurve WHERE P > 0),
vf2 AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10) AS f1 FROM vf),
best AS (SELECT * FROM vf2 ORDER BY f1 DESC, threshold ASC LIMIT 1)"""

q("best_f1_threshold", f"""WITH {SCORED_CTE}, {BEST_CTE}
SELECT {R6('threshold', 'threshold')}, {R6('precision', 'precision')}, {R6('recall', 'recall')}, {R6('f1', 'f1')}
FROM best""")

CONF_CTE = f"""{BEST_CTE},
cc AS (SELECT MIN(best.threshold) AS threshold,
              COUNT(*) FILTER (WHERE churn = 1 AND churn_probability >= best.threshold) AS tp,
              COUNT(*) FILTER (WHERE churn = 0 AND churn_probability >= best.threshold) AS fp,
              COUNT(*) FILTER (WHERE churn = 1 AND churn_probability < best.threshold) AS fn,
              COUNT(*) FILTER (WHERE churn = 0 AND churn_probability < best.threshold) AS tn
       FROM scored, best WHERE split = 'test')"""

q("threshold_metrics", f"""WITH {SCORED_CTE}, {CONF_CTE},
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM cc)
SELECT {R6('threshold', 'threshold')}, tp, fp, fn, tn, {R6('precision', 'precision')}, {R6('recall', 'recall')},
       {R6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END', 'f1')},
       {R6('CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) END', 'accuracy')}
FROM m""")

q("confusion", f"""WITH {SCORED_CTE}, {CONF_CTE},
n AS (SELECT *, tp + fp + fn + tn AS total FROM cc)
SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, CAST(c AS BIGINT) AS count,
       {R6('CASE WHEN total > 0 THEN c / total * 100 END', 'pct')}
FROM (SELECT 0 AS a, 0 AS p, tn AS c, total FROM n UNION ALL SELECT 0, 1, fp, total FROM n
      UNION ALL SELECT 1, 0, fn, total FROM n UNION ALL SELECT 1, 1, tp, total FROM n)""")


def _prf(tp: str, fp: str, fn: str) -> str:
    p = f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END"
    return p, r


_p1, _r1 = _prf("tp", "fp", "fn")
_p0, _r0 = _prf("tn", "fn", "fp")
q("class_report", f"""WITH {SCORED_CTE}, {CONF_CTE},
a AS (SELECT {_p0} AS p0, {_r0} AS r0, tn + fp AS s0, {_p1} AS p1, {_r1} AS r1, tp + fn AS s1 FROM cc),
b AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
             CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, s0 + s1 AS st FROM a),
rows AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM b
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM b
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, st FROM b
  UNION ALL SELECT 'weighted avg',
        CASE WHEN st > 0 THEN (p0 * s0 + p1 * s1) / st ELSE 0 END,
        CASE WHEN st > 0 THEN (r0 * s0 + r1 * s1) / st ELSE 0 END,
        CASE WHEN st > 0 THEN (f0 * s0 + f1 * s1) / st ELSE 0 END, st FROM b)
SELECT class, {R6('precision', 'precision')}, {R6('recall', 'recall')}, {R6('f1', 'f1')},
       CAST(support AS BIGINT) AS support FROM rows""")

# steps of 0.05 from 0.1 as doubles add up: start + i * ((start + step) - start)
THRESHOLDS = ", ".join(f"(0.1::DOUBLE + {i} * ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE))" for i in range(16))
q("threshold_sweep", f"""WITH {SCORED_CTE},
ts(threshold) AS (VALUES {THRESHOLDS}),
c AS (SELECT ts.threshold,
             COUNT(*) FILTER (WHERE s.churn = 1 AND s.churn_probability >= ts.threshold) AS tp,
             COUNT(*) FILTER (WHERE s.churn = 0 AND s.churn_probability >= ts.threshold) AS fp,
             COUNT(*) FILTER (WHERE s.churn = 1 AND s.churn_probability < ts.threshold) AS fn,
             COUNT(*) FILTER (WHERE s.churn = 0 AND s.churn_probability < ts.threshold) AS tn
      FROM ts, (SELECT * FROM scored WHERE split = 'test') s GROUP BY ts.threshold),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT {R6('threshold', 'threshold')}, tp, fp, fn, tn, {R6('precision', 'precision')}, {R6('recall', 'recall')},
       {R6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END', 'f1')}
FROM m""")

TEST_CURVE = _curve_cte("test", "tcurve")
q("roc_curve", f"""WITH {SCORED_CTE}, {TEST_CURVE}
SELECT {R6('threshold', 'threshold')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {R6('CASE WHEN N > 0 THEN fp / N END', 'fpr')}, {R6('CASE WHEN P > 0 THEN tp / P END', 'tpr')}
FROM tcurve""")

q("pr_curve", f"""WITH {SCORED_CTE}, {TEST_CURVE}
SELECT {R6('threshold', 'threshold')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {R6('tp / (tp + fp)', 'precision')}, {R6('CASE WHEN P > 0 THEN tp / P END', 'recall')}
FROM tcurve""")

q("auc_summary", f"""WITH {SCORED_CTE}, {TEST_CURVE}
SELECT {R6('SUM(CASE WHEN P > 0 AND N > 0 THEN (neg / N) * ((2 * tp - pos) / (2 * P)) END)', 'roc_auc')},
       {R6('SUM(CASE WHEN P > 0 THEN (pos / P) * (tp / (tp + fp)) END)', 'average_precision')},
       CAST(MIN(P) AS BIGINT) AS n_pos, CAST(MIN(P) + MIN(N) AS BIGINT) AS n,
       {R6('MIN(P) / (MIN(P) + MIN(N))', 'baseline_rate')}
FROM tcurve""")

# ----------------------------------------------------------------- linear attribution
_feat_vals = ", ".join(f"('{f}', {i}, '{WEIGHTS.get(f, 0)}'::DOUBLE)"
                       for i, f in enumerate(S.FEATURES))
_long = " UNION ALL ".join(f"SELECT loyalty_number, '{f}' AS feature, {_g(f)} AS feature_value FROM mt"
                           for f in S.FEATURES)
_means = " UNION ALL ".join(f"SELECT '{f}' AS feature, AVG({_g(f)}) AS mean FROM mtrain" for f in S.FEATURES)
ATTR_CTE = f"""{FEATURES_CTE},
mx AS (SELECT * FROM features),
mt AS (SELECT * FROM mx WHERE split = 'test'),
mtrain AS (SELECT * FROM mx WHERE split = 'train'),
fw(feature, feature_index, weight) AS (VALUES {_feat_vals}),
means AS ({_means}),
w AS (SELECT fw.*, means.mean FROM fw JOIN means USING (feature)),
attr AS (SELECT l.loyalty_number, l.feature, CAST(w.feature_index AS INTEGER) AS feature_index, l.feature_value,
                w.weight * (l.feature_value - w.mean) AS shap_value
         FROM ({_long}) l JOIN w USING (feature)),
base AS (SELECT SUM(weight * mean) + '-1.0'::DOUBLE AS base_value FROM w)"""

_ATTR_COLS = f"loyalty_number, feature, feature_index, {R6('feature_value', 'feature_value')}, {R6('shap_value', 'shap_value')}"
q("linear_attribution", f"WITH {ATTR_CTE} SELECT {_ATTR_COLS} FROM attr")

# factors, texts and waterfalls are given for every customer
_ALL_CTE = ATTR_CTE.replace("mt AS (SELECT * FROM mx WHERE split = 'test')", "mt AS (SELECT * FROM mx)")
TOP_CTE = f"""{_ALL_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY loyalty_number ORDER BY abs(shap_value) DESC, feature_index ASC)
                  AS rank FROM attr)"""
q("linear_top_factors", f"""WITH {TOP_CTE}
SELECT {_ATTR_COLS}, CAST(rank AS INTEGER) AS rank,
       CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM ranked WHERE rank <= 5""")


def _pct0(x: str) -> str:
    return f"format('{{:.0f}}', {x} * 100.0::DOUBLE) || '%'"


_whole = "CAST(trunc(feature_value) AS BIGINT)::VARCHAR"
_text = f"""CASE feature
  WHEN 'flight_trend_yoy' THEN 'Flight activity ' || CASE WHEN feature_value < 0 THEN 'decreased' ELSE 'increased' END
       || ' by ' || format('{{:.1f}}', abs(feature_value)) || ' flights year-over-year'
  WHEN 'recency_last_flight' THEN CASE WHEN feature_value > 0 THEN 'Last flight was ' || {_whole} || ' months ago'
       ELSE 'Recently active flyer' END
  WHEN 'total_flights_24m' THEN CASE WHEN feature_value < 10 THEN 'Only ' ELSE '' END || {_whole}
       || ' total flights in 24 months'
  WHEN 'is_promotion_enrollee' THEN CASE WHEN feature_value = 1
       THEN 'Enrolled through 2018 promotion (higher churn risk segment)' ELSE 'Standard enrollment' END
  WHEN 'points_utilization' THEN CASE WHEN feature_value < 0.3 THEN 'Low' ELSE 'High' END
       || ' points utilization (' || {_pct0('feature_value')} || ')'
  WHEN 'clv' THEN 'Customer Lifetime Value: $' || format('{{:,.2f}}', feature_value)
  WHEN 'clv_per_year' THEN 'Annualized CLV: $' || format('{{:,.2f}}', feature_value)
  WHEN 'tenure_months' THEN 'Member for ' || {_whole} || ' months'
  WHEN 'companion_ratio' THEN {_pct0('feature_value')} || ' of flights with companions'
  WHEN 'months_active' THEN 'Active in ' || {_whole} || ' of 24 months'
  WHEN 'loyalty_tier_numeric' THEN CASE WHEN feature_value = 1 THEN 'Star' WHEN feature_value = 2 THEN 'Nova'
       ELSE 'Aurora' END || ' tier member'
  WHEN 'redemption_frequency' THEN 'Redeems points ' || {_pct0('feature_value')} || ' of months'
  WHEN 'salary' THEN 'Salary: ' || format('{{:.2f}}', feature_value)
  WHEN 'marital_married' THEN 'marital_Married: ' || format('{{:.2f}}', feature_value)
  WHEN 'marital_single' THEN 'marital_Single: ' || format('{{:.2f}}', feature_value)
  WHEN 'country_united_states' THEN 'country_United States: ' || format('{{:.2f}}', feature_value)
  ELSE feature || ': ' || format('{{:.2f}}', feature_value) END"""
q("factor_explanations", f"""WITH {TOP_CTE}
SELECT loyalty_number, CAST(rank AS INTEGER) AS rank, feature, {_text} AS text,
       CASE WHEN shap_value > 0 THEN 'risk factor' ELSE 'retention factor' END AS impact,
       {R6('shap_value', 'shap_value')}
FROM ranked WHERE rank <= 5""")

q("waterfall_rows", f"""WITH {TOP_CTE},
g AS (SELECT loyalty_number, least(rank, 10) AS position, SUM(shap_value) AS value, MIN(feature) AS f,
             MIN(feature_value) AS fv, COUNT(*) AS n
      FROM ranked GROUP BY loyalty_number, least(rank, 10)),
e AS (SELECT g.*, base.base_value + SUM(value) OVER (PARTITION BY loyalty_number ORDER BY position DESC
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "end"
      FROM g, base)
SELECT loyalty_number, CAST(position AS INTEGER) AS position,
       CASE WHEN position <= 9 THEN f ELSE n::VARCHAR || ' other features' END AS label,
       {R6('CASE WHEN position <= 9 THEN fv END', 'feature_value')}, {R6('value', 'value')},
       {R6('"end" - value', 'start')}, {R6('"end"', '"end"')}
FROM e""")

_display = "CASE feature " + " ".join(
    f"WHEN '{f}' THEN '{f.replace('_', ' ').title()}'" for f in S.FEATURES) + " END"
q("global_importance", f"""WITH {ATTR_CTE},
g AS (SELECT feature, feature_index, AVG(abs(shap_value)) AS importance FROM attr GROUP BY feature, feature_index)
SELECT feature, feature_index, {_display} AS display_name, {R6('importance', 'importance')},
       CAST(row_number() OVER (ORDER BY importance DESC, feature_index ASC) AS INTEGER) AS rank
FROM g""")

q("beeswarm_data", f"""WITH {ATTR_CTE},
g AS (SELECT feature, row_number() OVER (ORDER BY AVG(abs(shap_value)) DESC, MIN(feature_index)) AS rank FROM attr GROUP BY feature)
SELECT loyalty_number, feature, CAST(rank AS INTEGER) AS rank, {R6('feature_value', 'feature_value')},
       {R6('shap_value', 'shap_value')},
       {R6('percent_rank() OVER (PARTITION BY feature ORDER BY round(feature_value, 9))', 'value_percent_rank')}
FROM attr JOIN g USING (feature) WHERE rank <= 15""")

q("segment_quantile_sketches", f"""WITH {SCORED_CTE}, p(probability) AS (VALUES (0.25::DOUBLE), (0.5), (0.75)),
g AS (SELECT loyalty_card AS selection, COUNT(*) AS n FROM scored GROUP BY loyalty_card UNION ALL SELECT 'all', COUNT(*) FROM scored)
SELECT selection, probability, n, true AS within_one_percent FROM g, p""")
