"""Score-consumer plans over the fixture score.

The fixture score is a fixed-weight logistic over five features; with it every
consumer (bands, summaries, ROI, recommendations, evaluation, attribution)
is checkable against SQL without a fitted model.  The same operators take a
fitted model's scores (see ``catalog_models``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import evaluate as EV
from ..operators import explain as EX
from ..operators import retention as RT
from ..operators import scoring as SC
from ..operators import segments as SG
from ..operators import split as SP
from ..operators.features import model_matrix
from . import tables as TB
from .catalog import query

R = TB.round_doubles


def scored(spark, d):
    return SC.score_fixture(TB.feature_store(spark, d))


def scored_split(spark, d):
    return TB.with_split(spark, d, scored(spark, d))


def tuned_threshold(spark, d):
    """Decision threshold = best-F1 score on the validation split (one row)."""
    v = scored_split(spark, d).where(F.col("split") == "validation")
    return EV.best_f1_threshold(v).select("threshold")


def test_rows(spark, d):
    return scored_split(spark, d).where(F.col("split") == "test")


def linear_attr(spark, d):
    m = TB.with_split(spark, d, model_matrix(TB.feature_store(spark, d)))
    return EX.linear_attribution(m.where(F.col("split") == "test"), m.where(F.col("split") == "train"),
                                 S.FIXTURE_WEIGHTS, S.FIXTURE_INTERCEPT)


def linear_rows(spark, d):
    """Every customer's factors, against the training split as background."""
    m = model_matrix(TB.feature_store(spark, d))
    train = TB.with_split(spark, d, m).where(F.col("split") == "train")
    return EX.linear_factors(m, train, S.FIXTURE_WEIGHTS, S.FIXTURE_INTERCEPT)


@query("fixture_scores")
def q_fixture_scores(spark, d):
    return R(scored(spark, d).select("loyalty_number", "churn", "churn_probability", "risk_level",
                                     "predicted_churn"))


@query("risk_bands")
def q_risk_bands(spark, d):
    return R(SC.risk_band_counts(scored(spark, d)))


@query("high_risk_list")
def q_high_risk_list(spark, d):
    return R(SC.high_risk_list(scored(spark, d)))


@query("top20_risk")
def q_top20_risk(spark, d):
    return R(SC.top_risk(scored(spark, d), 20))


@query("risk_tier_summary")
def q_risk_tier_summary(spark, d):
    return R(RT.risk_tier_summary(scored(spark, d)))


@query("scoring_summary")
def q_scoring_summary(spark, d):
    return R(SC.scoring_summary(scored(spark, d)))


@query("roi_grid")
def q_roi_grid(spark, d):
    return R(RT.roi_grid(scored(spark, d)))


@query("action_list")
def q_action_list(spark, d):
    return R(RT.action_list(scored(spark, d)))


@query("recommendations")
def q_recommendations(spark, d):
    return RT.recommendations(scored(spark, d))


@query("strategy_impact")
def q_strategy_impact(spark, d):
    return R(RT.strategy_impact(scored(spark, d)))


@query("hist_probability")
def q_hist_probability(spark, d):
    return R(SG.histogram(scored(spark, d), "churn_probability", 30, by=None, domain=(0.0, 1.0),
                          marker=S.DEFAULT_THRESHOLD))


# ----------------------------------------------------------------- split / evaluation
@query("split_assignment")
def q_split_assignment(spark, d):
    return TB.with_split(spark, d, TB.feature_store(spark, d)).select("loyalty_number", "churn", "split")


@query("class_weights")
def q_class_weights(spark, d):
    f = TB.with_split(spark, d, TB.feature_store(spark, d))
    return R(SP.class_weights(f.where(F.col("split") == "train")))


@query("best_f1_threshold")
def q_best_f1_threshold(spark, d):
    v = scored_split(spark, d).where(F.col("split") == "validation")
    return R(EV.best_f1_threshold(v))


@query("threshold_metrics")
def q_threshold_metrics(spark, d):
    return R(EV.threshold_metrics(test_rows(spark, d), tuned_threshold(spark, d)))


@query("confusion")
def q_confusion(spark, d):
    return R(EV.confusion_matrix(test_rows(spark, d), tuned_threshold(spark, d)))


@query("class_report")
def q_class_report(spark, d):
    return R(EV.class_report(test_rows(spark, d), tuned_threshold(spark, d)))


@query("threshold_sweep")
def q_threshold_sweep(spark, d):
    return R(EV.threshold_sweep(test_rows(spark, d)))


@query("roc_curve")
def q_roc_curve(spark, d):
    return R(EV.roc_curve(test_rows(spark, d)))


@query("pr_curve")
def q_pr_curve(spark, d):
    return R(EV.pr_curve(test_rows(spark, d)))


@query("auc_summary")
def q_auc_summary(spark, d):
    return R(EV.auc_summary(test_rows(spark, d)))


# ----------------------------------------------------------------- attribution (linear)
@query("linear_attribution")
def q_linear_attribution(spark, d):
    values, _ = linear_attr(spark, d)
    return R(values)


@query("linear_top_factors")
def q_linear_top_factors(spark, d):
    return R(EX.top_of(linear_rows(spark, d), 5))


@query("factor_explanations")
def q_factor_explanations(spark, d):
    return R(EX.explanations_of(linear_rows(spark, d), 5))


@query("waterfall_rows")
def q_waterfall_rows(spark, d):
    return R(EX.waterfall_of(linear_rows(spark, d)))


@query("global_importance")
def q_global_importance(spark, d):
    values, _ = linear_attr(spark, d)
    return R(EX.global_importance(values))


@query("beeswarm_data")
def q_beeswarm_data(spark, d):
    values, _ = linear_attr(spark, d)
    return R(EX.beeswarm_data(values, EX.global_importance(values)))


@query("segment_quantile_sketches")
def q_segment_quantile_sketches(spark, d):
    """AG18 at scale — a stored sketch of the probability per tier and province, merged for every tier and for all;
    returned are the quartiles' true rank errors being within 1 % of the ranks."""
    from ..operators import sketches as SK
    from ..sources import sinks
    from ..sources.store import ArtifactStore
    from ..session import ensure_checkpoint_dir
    import uuid

    s = scored(spark, d).select("loyalty_card", "province", "churn_probability")
    store = ArtifactStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-io/{uuid.uuid4().hex}")
    run = store.begin()
    sinks.write_parquet(SK.sketch(s, "churn_probability", ["loyalty_card", "province"]), run.path("sketches"))
    store.publish(run)
    stored = spark.read.parquet(store.latest().path("sketches"))
    out = None
    for by in (["loyalty_card"], []):
        estimates = SK.quantiles(SK.merge(stored, by), [0.25, 0.5, 0.75])
        errors = SK.rank_errors(s, "churn_probability", estimates.drop("n"), by)
        named = estimates.select(*by, "probability", "n").join(errors, [*by, "probability"])
        named = named.select((F.col(by[0]) if by else F.lit("all")).alias("selection"), "probability", "n",
                             (F.col("rank_error") <= 0.01).alias("within_one_percent"))
        out = named if out is None else out.unionByName(named)
    return out
