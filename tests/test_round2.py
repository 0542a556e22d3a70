"""Edges named in the review: weighted covers, header binding, absent columns, rows outside the years."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from churnlens import schemas as S
from churnlens.operators import ensemble as EN
from churnlens.operators import features as FT
from churnlens.operators import resample as RS
from churnlens.operators import retention as RT
from churnlens.operators import train as TR
from churnlens.operators import treeshap as TS
from churnlens.operators.features import model_matrix
from conftest import ACT_SCHEMA, activity_rows

FEATS = ["f0", "f1", "f2"]


def _rows(spark, n=300):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.4, size=n) > 0.6).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(c), 2.5 if c else 1.0) for i, (r, c) in enumerate(zip(x, y))],
                                 ["loyalty_number", *FEATS, "churn", "weight"])


def test_base_value_counts_rows_not_weights(spark):
    df = _rows(spark)
    vec = VectorAssembler(inputCols=FEATS, outputCol="features").transform(df).coalesce(1).cache()
    model = GBTClassifier(labelCol="churn", weightCol="weight", maxIter=1, maxDepth=2, seed=4).fit(vec)
    values, base = TS.tree_attribution(model, df, features=FEATS)
    # with one tree and covers by rows, the base is the mean margin of the training rows
    margins = 2 * np.array([r["rawPrediction"][1] for r in model.transform(vec).select("rawPrediction").collect()])
    assert abs(base.first()[0] - margins.mean()) < 1e-9
    total = values.groupBy("loyalty_number").agg(F.sum("shap_value").alias("s")).orderBy("loyalty_number").collect()
    assert np.allclose([r["s"] + base.first()[0] for r in total], margins)


def test_upload_binds_columns_by_header(spark, tmp_path):
    from churnlens.streaming import start_scoring
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=31)), int(rng.integers(0, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, ["loyalty_number", *S.FEATURES, "churn"])
    model = EN.Ensemble(S.FIXTURE_TREES, df)
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.csv").write_text("recency_last_flight,Loyalty Number,Salary,total_flights_24m\n24,1,50000,3\n")
    (up / "b.csv").write_text("loyalty_number,CLV\n2,900\n")
    start_scoring(spark, str(up), str(tmp_path / "out"), str(tmp_path / "chk"), model, 0.5).awaitTermination()
    got = {r["loyalty_number"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got[1]["recency_last_flight"], got[1]["salary"], got[1]["total_flights_24m"]) == (24.0, 50000.0, 3.0)
    assert got[2]["clv"] == 900.0 and got[2]["salary"] == 0.0
    want = spark.createDataFrame([(1, 24.0, 50000.0, 3.0)], ["loyalty_number", "recency_last_flight", "salary", "total_flights_24m"])
    p = TR.predict(model, model_matrix(want, label=None)).first()["churn_probability"]
    assert abs(got[1]["churn_probability"] - p) < 1e-12


def test_action_list_takes_absent_columns_as_zero(spark):
    df = spark.createDataFrame([(1, 100.0, 0.9, "High")], ["loyalty_number", "clv", "churn_probability", "risk_level"])
    text = RT.action_list(df).first()["recommended_actions"]
    assert text == "Points engagement campaign"


def test_rows_outside_the_years_fail(spark):
    rows = activity_rows(1, {3: 2.0}) + [(1, 2019, 1, 50.0, 50.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    act = spark.createDataFrame(rows, ACT_SCHEMA)
    with pytest.raises(Exception, match="outside the observed years"):
        FT.flight_features(act).collect()
    assert FT.flight_features(act, outside="ignore").first()["total_flights_24m"] == 2.0


def test_one_minority_row_is_refused(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 0.0, int(i == 0)) for i in range(30)], ["loyalty_number", *FEATS, "churn"])
    with pytest.raises(Exception, match="two minority rows"):
        RS.oversample(df, features=FEATS).collect()
