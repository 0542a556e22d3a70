"""Model training (ML4–ML10).

* Logistic baseline: ``VectorAssembler → StandardScaler → LogisticRegression``
  with a class weight column; L2 strength matches an inverse-regularisation
  C = 1 on the weighted loss (regParam = 1 / Σ weights).
* Boosted trees: :mod:`boost`, with all parameters of the original booster's search space.
* Search: random trials over the categorical space (or the fallback grid); all fits go on together in shared
  passes over the training rows, results are kept in a ledger; the objective is validation F1 at the
  best-F1 validation threshold.  Only histograms and metrics reach the driver.
"""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import evaluate as EV
from .scoring import PROBABILITY, add_bands

def with_weight(df: DataFrame, pos_weight, label: str = "churn") -> DataFrame:
    """Weight column: ``pos_weight`` for positives, 1 otherwise (float or one-row DataFrame)."""
    if isinstance(pos_weight, DataFrame):
        from .segments import attach_scalar
        df = attach_scalar(df, pos_weight.select(F.col("scale_pos_weight").alias("_pw")))
        return df.withColumn("weight", F.when(F.col(label) == 1, F.col("_pw")).otherwise(F.lit(1.0))).drop("_pw")
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def assembler(features: list[str] = S.FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def fit_logistic(train: DataFrame, features: list[str] = S.FEATURES, label: str = "churn",
                 max_iter: int = 1000) -> PipelineModel:
    """ML4 + ML5 — standardised L2 logistic regression with class weights."""
    total_w = train.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=max_iter,
                            regParam=1.0 / float(total_w), elasticNetParam=0.0, standardization=False,
                            tol=1e-6)
    pipe = Pipeline(stages=[assembler(features),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            lr])
    return pipe.fit(train)


def logistic_gradient(model: PipelineModel, train: DataFrame, label: str = "churn") -> DataFrame:
    """ML5's certificate: the largest component of the gradient of the penalised weighted loss at the fitted
    coefficients, 0 at the optimum.  One aggregate of as many columns as there are coefficients."""
    assemble, scale, lr = model.stages
    names, reg = assemble.getInputCols(), float(lr.getOrDefault("regParam"))
    z = {f: f"((`{f}` - {float(m)!r}D) / {float(s) or 1.0!r}D)" for f, m, s in zip(names, scale.mean, scale.std)}
    beta = dict(zip(names, map(float, lr.coefficients)))
    margin = " + ".join([f"{float(lr.intercept)!r}D"] + [f"{b!r}D * {z[f]}" for f, b in beta.items()])
    off = f"weight * (1D / (1D + exp(-({margin}))) - `{label}`)"
    rows = train.selectExpr(*[f"{z[f]} AS `{f}`" for f in names], f"{off} AS _off", "weight AS _w")
    sums = rows.selectExpr("sum(_off) / sum(_w) AS _b", *[f"sum(_off * `{f}`) / sum(_w) + {reg * beta[f]!r}D AS `{f}`" for f in names])
    return sums.select(F.greatest(*[F.abs(F.col(c)) for c in sums.columns]).alias("gradient"))


def predict(model, df: DataFrame) -> DataFrame:
    """SC1 — P(churn) as a double column, from a fitted pipeline or an ensemble."""
    if hasattr(model, "predict"):
        return model.predict(df)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df).withColumn(PROBABILITY, vector_to_array("probability")[1])
    return out.drop(*[c for c in ("features", "scaled", "rawPrediction", "probability", "prediction")
                      if c in out.columns])


def validation_f1(model, valid: DataFrame, label: str = "churn") -> tuple[float, float]:
    """(F1 on validation at the best-F1 validation threshold, that threshold)."""
    scored = predict(model, valid).select(label, PROBABILITY)
    best = EV.best_f1_threshold(scored, label)
    m = EV.threshold_metrics(scored, best.select("threshold"), label).first()
    return float(m["f1"]), float(m["threshold"])


def random_trials(space: dict = S.SEARCH_SPACE, n_trials: int = S.SEARCH_TRIALS, seed: int = S.SPLIT_SEED):
    rng = random.Random(seed)
    for _ in range(n_trials):
        yield {k: rng.choice(v) for k, v in space.items()}


def grid_trials(space: dict = S.GRID_SPACE):
    keys = list(space)
    for values in itertools.product(*[space[k] for k in keys]):
        yield dict(zip(keys, values))


_LEDGER = "fit string, n_trees int, validation_f1 double, threshold double"


def _ledger_rows(spark, path: str) -> dict[tuple[str, int], tuple[float, float]]:
    """Finished evaluations of an earlier run; a fit's folder counts once it is complete."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    done = [str(f.getPath().toString()) for f in fs.listStatus(root)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return {}
    return {(r["fit"], r["n_trees"]): (r["validation_f1"], r["threshold"])
            for r in spark.read.schema(_LEDGER).parquet(*done).collect()}                     # as many as trials


def search(train: DataFrame, valid: DataFrame, trials, label: str = "churn", ledger: str | None = None,
           every: int = 8) -> tuple[DataFrame, dict, list | None]:
    """ML7 / ML8 — score each trial by validation F1; strictly better wins (earlier trial wins a tie, as in a
    sequential search).

    All fits go on together in shared passes over the rows (:mod:`boost`).  Trials that differ only in the number of
    trees share one fit, which is evaluated at each number asked.  Evaluations that are done are appended to
    ``ledger``, a folder of small tables; a search that finds some there fits the others only.
    Returns the trials table, the best parameters, and their trees (None if they came from the ledger).
    """
    import hashlib
    import json
    import uuid

    from ..session import ensure_checkpoint_dir
    from . import boost as BO

    spark, trials = train.sparkSession, list(trials)
    ledger = ledger or f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-ledger/{uuid.uuid4().hex}"
    name = lambda p: hashlib.sha1(json.dumps(BO.shape(p), sort_keys=True).encode()).hexdigest()[:16]
    known = _ledger_rows(spark, ledger)
    missing = [p for p in trials if (name(p), int(p["n_estimators"])) not in known]
    session = None
    if missing:
        def evaluated(session, scores: DataFrame) -> None:
            best = EV.best_f1_thresholds(scores, ["model", "n_trees"], label)
            rows = [(name(session.fits[r["model"]].p), r["n_trees"], r["f1"], r["threshold"]) for r in best.collect()]   # as many as trials
            spark.createDataFrame(rows, _LEDGER).coalesce(1).write.parquet(f"{ledger}/{uuid.uuid4().hex}")
            known.update({(f, n): (f1, t) for f, n, f1, t in rows})

        session = BO.fit_all(train, valid, missing, evaluated, label, every=every)
        session.close()
    rows, best, best_f1 = [], None, -1.0
    for i, p in enumerate(trials):
        f1, t = known[name(p), int(p["n_estimators"])]
        rows.append((i, str(sorted(p.items())), f1, t, name(p)))
        if f1 > best_f1:
            best, best_f1 = p, f1
    table = spark.createDataFrame(rows, "trial int, params string, validation_f1 double, threshold double, fit string")
    return table, best, session.trees(best) if session and best in missing else None


def training_rows(train: DataFrame, label: str = "churn") -> DataFrame:
    """ML2, ML3 — the oversampled training split with its class weights, in as many partitions as its size asks."""
    from .resample import oversample
    from .split import class_weights
    rows = with_weight(oversample(train, label), class_weights(train, label)).checkpoint()
    return rows.repartition(max(1, -(-rows.count() // 50_000)))


def train_job(features: DataFrame, store=None, params: dict | None = None, n_trials: int = 0, label: str = "churn",
              booster: bool = True, ledger: str | None = None, cuts=None) -> dict:
    """ML10 — split → oversample → weight → baseline → booster → thresholds → test evaluation → attributions →
    persistence.

    Without a booster the baseline stands in for it, as in the original: model, threshold and metrics of ``gbt`` are the
    baseline's, and there are neither parameters nor attributions.  With a ``sources.store.ArtifactStore`` everything
    is written as one run and published at the end: both models, thresholds, metrics, feature names, best
    parameters, trials, held-out rows, and attributions with their base value.  Returns models, thresholds and DataFrames.
    """
    from ..sources import sinks
    from . import boost as BO
    from . import ensemble as EN
    from .features import model_matrix
    from .split import assign_split, class_weights

    spark = features.sparkSession
    m = assign_split(model_matrix(features), cuts=cuts).cache()      # reused by every fit and evaluation
    train, valid, test = (m.where(F.col("split") == s) for s in ("train", "validation", "test"))
    weights = class_weights(train, label)
    resampled = training_rows(train, label).cache()
    lr_model = fit_logistic(resampled)
    trials = None
    gbt_model, params, trees = lr_model, (params or S.STORED_PARAMS) if booster else None, None
    if booster:
        if n_trials:
            trials, params, trees = search(resampled, valid, random_trials(n_trials=n_trials), label, ledger=ledger)
        gbt_model = EN.Ensemble(trees or BO.fit(resampled, params, label=label), train)
    models = {"gbt": gbt_model, "lr": lr_model}
    thresholds = {name: validation_f1(model, valid, label)[1] for name, model in models.items()}
    tdf = spark.createDataFrame(list(thresholds.items()), "model string, threshold double")
    scored_test = {name: add_bands(predict(model, test), thresholds[name]) for name, model in models.items()}
    comparison = EV.model_comparison({n: (df, thresholds[n]) for n, df in scored_test.items()}, label)
    published = None
    if store is not None:
        run = store.begin()
        sinks.save_model(lr_model, run.path("lr"))
        sinks.write_json_table(tdf, run.path("thresholds"))
        sinks.write_json_table(comparison, run.path("metrics"))
        sinks.write_json_table(spark.createDataFrame([(i, f) for i, f in enumerate(S.FEATURES)], "position int, feature string"),
                               run.path("feature_names"))
        sinks.write_parquet(test.select("loyalty_number", *S.FEATURES, label), run.path("test_set"))
        if trials is not None:
            sinks.write_parquet(trials, run.path("trials"))
        if booster:
            EN.write_trees(spark, gbt_model.trees, run.path("gbt"))
            sinks.write_json_table(spark.createDataFrame([(k, float(v)) for k, v in sorted(params.items())], "parameter string, value double"),
                                   run.path("parameters"))
            arrays = EN.attribution_arrays(gbt_model.leaves, test.select("loyalty_number", *S.FEATURES))
            sinks.write_attributions(arrays.select("loyalty_number", "phi"), spark.createDataFrame([(float(gbt_model.base),)], "base_value double"),
                                     run.path("attributions"))
        run.notes = {"booster": "gbt" if booster else "lr"}
        published = store.publish(run)
    return {**models, "thresholds": thresholds, "threshold_table": tdf, "comparison": comparison, "trials": trials,
            "parameters": params, "resampled": resampled, "splits": m, "scored_test": scored_test, "weights": weights,
            "published": published}
