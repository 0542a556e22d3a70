"""Model plans: over the fixture ensemble (SQL-checked) and over fitted models.

The fixture ensemble is a small boosted model held as fixed data; with it scoring, attribution, importance,
dependence, evaluation and the stream are checkable against SQL.  The same operators take a fitted model:
``fitted_model_checks`` runs them on it and returns their invariants.  Fitted models are kept per (session,
table directory) for the life of the process, so the plans over them share one training run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..operators import resample as RS
from ..operators import scoring as SC
from ..operators import train as TR
from ..operators.features import model_matrix
from ..operators.scoring import PROBABILITY
from . import artifacts as AR
from . import tables as TB
from .catalog import query
from .catalog_scoring import scored_split as fixture_split

R = TB.round_doubles


def fixture_ensemble(spark, d) -> EN.Ensemble:
    """The fixture trees with the training split as background."""
    return EN.Ensemble(S.FIXTURE_TREES, AR.split_matrix(spark, d).where(F.col("split") == "train"))


def ensemble_scores(spark, d):
    return EN.score(AR.split_matrix(spark, d), S.FIXTURE_TREES)


def _of(df, split: str):
    return df.where(F.col("split") == split)


def _tuned(scores) -> float:
    return EV.best_f1_threshold(_of(scores, "validation")).first()["threshold"]


def _test_arrays(spark, d):
    return EN.attribution_arrays(fixture_ensemble(spark, d).leaves, _of(AR.split_matrix(spark, d), "test"))


@query("oversampled_train")
def q_oversampled_train(spark, d):
    rows = RS.oversample(_of(AR.split_matrix(spark, d), "train"))
    # nullable whole numbers are returned as doubles, as elsewhere
    return R(rows.withColumns({c: F.col(c).cast("double") for c in ("parent", "neighbor")}))


@query("lr_scores")
def q_lr_scores(spark, d):
    return AR.scored_split(spark, d, "lr").select("loyalty_number", "churn", "churn_probability", "risk_level",
                                         "predicted_churn")


@query("gbt_scores")
def q_gbt_scores(spark, d):
    return AR.scored_split(spark, d, "gbt").select("loyalty_number", "churn", "churn_probability", "risk_level",
                                          "predicted_churn")


@query("fitted_model_checks")
def q_fitted_model_checks(spark, d):
    """EX1, EV9, ML5 on the fitted models, over real rows: base + Σφ gives the booster's score of every held-out row, its
    ROC area exceeds 0.7, and no component of the baseline's gradient exceeds 1e-4."""
    a = AR.models(spark, d)
    m = AR.split_matrix(spark, d)
    rows = EN.attribution_arrays(a["gbt"].leaves, a["gbt"].predict(_of(m, "test")))
    margin = F.lit(float(a["gbt"].base)) + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    one = rows.agg(F.count("*").alias("rows_scored"), F.max(F.abs(1 / (1 + F.exp(-margin)) - F.col(PROBABILITY))).alias("off"))
    one = SC.attach_scalar(one, EV.auc_summary(rows).select("roc_auc"))
    one = SC.attach_scalar(one, TR.logistic_gradient(a["lr"], TR.training_rows(_of(m, "train"))))
    return one.select("rows_scored", (F.col("off") < 1e-6).alias("additive"), (F.col("roc_auc") > 0.7).alias("roc_above_07"),
                      (F.col("gradient") < 1e-4).alias("gradient_small"))


@query("ensemble_leaves")
def q_ensemble_leaves(spark, d):
    """EX1 — the relational form of the ensemble, with the training split's counts."""
    return R(EN.leaf_table(_of(AR.split_matrix(spark, d), "train"), S.FIXTURE_TREES))


@query("model_comparison")
def q_model_comparison(spark, d):
    """EV8 — ensemble and linear fixture on the test split, each at its own best-F1 threshold."""
    named = {"gbt": ensemble_scores(spark, d), "lr": fixture_split(spark, d)}
    return R(EV.model_comparison({n: (_of(s, "test"), _tuned(s)) for n, s in named.items()}))


@query("gbt_attribution")
def q_gbt_attribution(spark, d):
    return R(EN.long_attributions(_test_arrays(spark, d)))


@query("gbt_global_importance")
def q_gbt_global_importance(spark, d):
    return R(EN.importance(_test_arrays(spark, d)))


@query("dependence_data")
def q_dependence_data(spark, d):
    rows = _test_arrays(spark, d).checkpoint()
    return R(EN.dependence(rows, EN.importance(rows)))


@query("bulk_scoring")
def q_bulk_scoring(spark, d):
    """SC2 / SC3 — the whole customer base: probability, band, decision at the
    tuned threshold, and the top attribution factor per customer."""
    scores = ensemble_scores(spark, d)
    scored = fixture_ensemble(spark, d).with_top_factor(SC.add_bands(scores, _tuned(scores)))
    return R(scored.select("loyalty_number", "churn", "churn_probability", "risk_level", "predicted_churn", "top_risk_factor"))


def _search(spark, d, trials):
    m = AR.split_matrix(spark, d)
    table, _, _ = TR.search(TR.training_rows(_of(m, "train")), _of(m, "validation"), trials, ledger=AR.ledger(spark, d))
    return table


@query("trials_table")
def q_trials_table(spark, d):
    """ML7 — random search: every trial over the full space."""
    return _search(spark, d, TR.random_trials())


@query("grid_trials")
def q_grid_trials(spark, d):
    """ML8 — grid search over the whole fallback grid."""
    return _search(spark, d, TR.grid_trials())


@query("gbt_threshold_sweep")
def q_gbt_threshold_sweep(spark, d):
    return R(EV.threshold_sweep(_of(ensemble_scores(spark, d), "test")))


@query("stream_scoring")
def q_stream_scoring(spark, d):
    """IO9 → SC2 as a stream: the feature table is written as upload files under the
    shared checkpoint directory, scored by a file-stream query (available-now
    trigger) into a Parquet sink, and the sink is returned."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import sinks
    from ..streaming import start_scoring

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-stream/{uuid.uuid4().hex}"
    sinks.write_csv(model_matrix(TB.feature_store(spark, d), label=None), f"{root}/uploads")
    q = start_scoring(spark, f"{root}/uploads", f"{root}/scored", f"{root}/chk", fixture_ensemble(spark, d),
                      _tuned(ensemble_scores(spark, d)))
    q.awaitTermination()
    return R(spark.read.parquet(f"{root}/scored").select("loyalty_number", "churn_probability", "risk_level",
                                                          "predicted_churn", "top_risk_factor"))
