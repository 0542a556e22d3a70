"""Artifact runs, the training job's fallback, rejected cells, sketches and bucketed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens import schemas as S
from churnlens.operators import ensemble as EN
from churnlens.operators import sketches as SK
from churnlens.operators import train as TR
from churnlens.sources import readers, sinks
from churnlens.sources.store import ArtifactStore
from conftest import SF_SMALL


def test_a_run_is_seen_once_published_and_the_newest_wins(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    assert store.latest() is None
    killed = store.begin()                                              # written, never published
    spark.range(3).write.parquet(killed.path("t"))
    assert store.latest() is None
    one, two = store.begin(), store.begin()                             # two at once
    spark.range(5).write.parquet(one.path("t"))
    spark.range(7).write.parquet(two.path("t"))
    two.notes = {"who": "two"}
    assert store.publish(two).version == 1
    reader = store.latest()
    assert store.publish(one).version == 2
    assert spark.read.parquet(store.latest().path("t")).count() == 5
    assert spark.read.parquet(reader.path("t")).count() == 7 and reader.notes == {"who": "two"}     # keeps its run
    with pytest.raises(KeyError):
        reader.path("other")


def test_a_manifest_cut_off_is_passed_over(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    run = store.begin()
    spark.range(2).write.parquet(run.path("t"))
    store.publish(run)
    (tmp_path / "manifests" / "000000000002.json").write_text('{"root": "x", "na')
    assert store.latest().version == 1
    again = store.begin()
    spark.range(4).write.parquet(again.path("t"))
    assert store.publish(again).version == 3 and spark.read.parquet(store.latest().path("t")).count() == 4


def test_training_without_a_booster_lets_the_baseline_stand_in(spark, tmp_path):
    from churnlens.plans import tables as TB
    store = ArtifactStore(spark, str(tmp_path))
    out = TR.train_job(TB.feature_store(spark, SF_SMALL), store, booster=False)
    run = store.latest()
    assert run.notes == {"booster": "lr"} and set(run.names) == {"lr", "thresholds", "metrics", "feature_names", "test_set"}
    rows = {r["model"]: r.asDict() for r in spark.read.json(run.path("metrics")).collect()}
    assert {k: v for k, v in rows["gbt"].items() if k != "model"} == {k: v for k, v in rows["lr"].items() if k != "model"}
    assert out["thresholds"]["gbt"] == out["thresholds"]["lr"]


def test_training_writes_parameters_attributions_and_held_out_rows(spark, tmp_path):
    from churnlens.plans import tables as TB
    store = ArtifactStore(spark, str(tmp_path))
    out = TR.train_job(TB.feature_store(spark, SF_SMALL), store, params={**S.STORED_PARAMS, "n_estimators": 3, "min_child_samples": 5})
    run = store.latest()
    assert {r["parameter"]: r["value"] for r in spark.read.json(run.path("parameters")).collect()}["n_estimators"] == 3
    assert EN.read_trees(spark, run.path("gbt")) == out["gbt"].trees and len(out["gbt"].trees) == 4
    values, base = readers.read_attributions(spark, run.path("attributions"))
    test = spark.read.parquet(run.path("test_set"))
    assert values.count() == test.count() > 0 and len(values.first()["phi"]) == 31
    scored = out["gbt"].predict(test).join(values, "loyalty_number")
    b = base.first()[0]
    for r in scored.collect():
        assert 1 / (1 + np.exp(-(b + sum(r["phi"])))) == pytest.approx(r["churn_probability"], abs=1e-5)
    assert readers.read_threshold(spark, run.path("thresholds"), "none").first()[0] == 0.5


def test_rejected_cells_and_unknown_columns(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.csv").write_text("Loyalty Number,Salary,comment,CLV\n1,n/a,x,5\n2,,y, \nx3,7,z,1e3\n4,8,,$9\n")
    got = sorted((r["loyalty_number"], r["column"], r["raw"], r["reason"]) for r in readers.rejected_cells(spark, str(up)).collect() if r["raw"])
    assert got == [("1", "salary", "n/a", "malformed"), ("4", "clv", "$9", "malformed"), ("x3", "loyalty_number", "x3", "malformed")]
    unknown = [r for r in readers.rejected_cells(spark, str(up)).collect() if r["raw"] is None]
    assert [(r["column"], r["reason"]) for r in unknown] == [("comment", "unknown column")] and unknown[0]["file"].endswith("a.csv")


def test_a_repeated_batch_rewrites_its_rejected_cells(spark, tmp_path):
    from churnlens.streaming import start_scoring
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.csv").write_text("Loyalty Number,Salary\n1,n/a\n2,5\n")
    rows = [(i, *map(float, np.random.default_rng(i).normal(size=31))) for i in range(30)]
    scorer = EN.Ensemble(S.FIXTURE_TREES, spark.createDataFrame(rows, ["loyalty_number", *S.FEATURES]))
    bad = str(tmp_path / "bad")
    for chk in ("one", "two"):                                          # the second has lost the progress of the first
        start_scoring(spark, str(up), str(tmp_path / "out"), str(tmp_path / chk), scorer, 0.5, rejected_dir=bad).awaitTermination()
    got = spark.read.parquet(bad).collect()
    assert [(r["loyalty_number"], r["raw"], r["batch_id"]) for r in got] == [("1", "n/a", 0)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_merged_sketches_keep_their_rank_error(spark):
    rng = random.Random(1)
    rows = [(f"s{i % 7}", rng.choice("xy"), rng.lognormvariate(0, 2) if i % 3 else float(rng.randint(0, 3))) for i in range(20000)]
    df = spark.createDataFrame(rows + [(None, "x", 1.0), ("s1", "y", None)], "s string, t string, v double")
    stored = SK.sketch(df, "v", ["s", "t"])
    for by in ([], ["t"], ["s"]):
        est = SK.quantiles(SK.merge(stored, by), [0.05, 0.25, 0.5, 0.75, 0.95])
        errors = SK.rank_errors(df, "v", est.drop("n"), by).collect()
        assert len(errors) == est.count() and max(r["rank_error"] for r in errors) <= 0.01
    some = SK.merge(stored.where("t = 'x'")).first()
    assert some["n"] == sum(1 for r in rows if r[1] == "x") + 1


def test_no_exchange_by_customer_on_the_stored_tables(spark):
    from churnlens.operators import features as FT
    from churnlens.operators import segments as SG
    from churnlens.plans import tables as TB
    activity, features = TB.activity_store(spark, SF_SMALL), TB.feature_store(spark, SF_SMALL)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(FT.flight_features(activity))
    trend = SG.monthly_trend(activity, features.select("loyalty_number", "churn"))
    assert "hashpartitioning(loyalty_number" not in plan(trend)
    joined = activity.join(features.hint("merge"), "loyalty_number").groupBy("loyalty_number").agg(F.sum("distance"))
    assert "Exchange" not in plan(joined)


def test_report_lines_as_in_the_original(spark):
    from churnlens.operators import scoring as SC
    df = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, 0.1)], "loyalty_number long, churn_probability double")
    text = sinks.format_summary_report(SC.scoring_summary(df), "2024-01-02 03:04:05", 1.5).first()["report"]
    assert text == """Batch Prediction Summary Report
================================
Date: 2024-01-02 03:04:05

Total Customers Processed: 3
Processing Time: 1.50 seconds

Risk Distribution:
- High Risk (>60%): 1 (33.3%)
- Medium Risk (30-60%): 1 (33.3%)
- Low Risk (<30%): 1 (33.3%)

Average Churn Probability: 46.7%
Median Churn Probability: 40.0%

Threshold Used: 0.50
"""
