"""Model invariants: exact tree attribution, oversampling, split, training."""

import itertools
import math

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from churnlens.operators import resample as RS
from churnlens.operators import split as SP
from churnlens.operators import treeshap as TS

FEATS = ["a", "b", "c", "d"]


def _toy(spark, n=240, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)) > 0).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "loyalty_number long, a double, b double, c double, d double, churn int")


def _tree_expectation(nodes, x, S):
    """Path-dependent E[f | x_S] of one tree by recursion (brute force)."""
    def rec(nid):
        n = nodes[nid]
        if n["leftChild"] < 0:
            return n["prediction"]
        f, thr = n["featureIndex"], n["threshold"]
        if f in S:
            return rec(n["leftChild"] if x[f] <= thr else n["rightChild"])
        l, r = nodes[n["leftChild"]], nodes[n["rightChild"]]
        return (l["cover"] * rec(n["leftChild"]) + r["cover"] * rec(n["rightChild"])) / n["cover"]
    return rec(0)


def test_tree_attribution_exact(spark, tmp_path):
    df = _toy(spark)
    vec = VectorAssembler(inputCols=FEATS, outputCol="features").transform(df)
    model = GBTClassifier(labelCol="churn", maxIter=4, maxDepth=3, seed=1).fit(vec)
    values, base = TS.tree_attribution(model, df, features=FEATS)
    phi = values.toPandas().pivot(index="loyalty_number", columns="feature_index", values="shap_value")
    b = base.first()[0]
    # additivity against the model's log-odds
    p = model.transform(vec).select("loyalty_number", "probability").toPandas().set_index("loyalty_number")
    logodds = p["probability"].map(lambda v: math.log(v[1] / (1 - v[1])))
    assert np.max(np.abs(phi.sum(axis=1) + b - logodds.loc[phi.index])) < 1e-9
    # brute-force Shapley values of the path-dependent game for a few rows
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    nodes_all = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.get("nodeData.impurityStats", 0).alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold")).collect()
    trees = {}
    for r in nodes_all:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    xs = df.orderBy("loyalty_number").limit(5).collect()
    m = len(FEATS)
    for row in xs:
        x = [row[f] for f in FEATS]
        for i in range(m):
            others = [j for j in range(m) if j != i]
            tot = 0.0
            for k in range(m):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    for tid, nodes in trees.items():
                        tw = 2 * model.treeWeights[tid]
                        tot += w * tw * (_tree_expectation(nodes, x, set(S) | {i}) - _tree_expectation(nodes, x, set(S)))
            assert abs(tot - phi.loc[row["loyalty_number"], i]) < 1e-9


def test_oversampling_invariants(spark):
    df = _toy(spark, n=200)
    out = RS.oversample(df, features=FEATS, block_rows=23)                    # forces several blocks
    pdf = out.toPandas()
    n_neg, n_pos = (pdf.synthetic.eq(0) & pdf.churn.eq(0)).sum(), (pdf.synthetic.eq(0) & pdf.churn.eq(1)).sum()
    syn = pdf[pdf.synthetic == 1]
    assert len(syn) == max(int(0.4 * n_neg - n_pos), 0)
    if len(syn):
        real = pdf[pdf.synthetic == 0].set_index("loyalty_number")
        for _, r in syn.iterrows():
            p, q = real.loc[r["parent"], FEATS].to_numpy(), real.loc[r["neighbor"], FEATS].to_numpy()
            x = r[FEATS].to_numpy(dtype=float)
            assert np.all(x >= np.minimum(p, q) - 1e-12) and np.all(x <= np.maximum(p, q) + 1e-12)


def test_exact_neighbours_match_brute_force(spark):
    df = _toy(spark, n=120).where("churn = 1")
    got = {r["loyalty_number"]: r["neighbors"] for r in RS.nearest_neighbors(df, FEATS, 5, block_rows=17).collect()}
    pdf = df.toPandas()
    x = pdf[FEATS].to_numpy()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    keys = pdf.loyalty_number.to_numpy()
    for i, k in enumerate(keys):
        assert list(keys[np.argsort(d[i], kind="stable")[:5]]) == got[k]


def test_stream_scoring_equals_batch(spark, tmp_path):
    from churnlens import schemas as S
    from churnlens.operators import train as TR
    from churnlens.operators.features import model_matrix
    from churnlens.sources import sinks
    from churnlens.streaming import start_scoring

    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=31)), int(rng.integers(0, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, ["loyalty_number", *S.FEATURES, "churn"])
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[TR.assembler(), GBTClassifier(labelCol="churn", maxIter=3, maxDepth=3, seed=1)]).fit(df)
    up = str(tmp_path / "uploads")
    # uploads may carry only some feature columns: the rest are aligned to 0
    sinks.write_csv(df.select("loyalty_number", *S.FEATURES[:20]).repartition(3), up)
    q = start_scoring(spark, up, str(tmp_path / "out"), str(tmp_path / "chk"), model, 0.5)
    q.awaitTermination()
    got = {r["loyalty_number"]: r["churn_probability"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = TR.predict(model, model_matrix(df.select("loyalty_number", *S.FEATURES[:20]), label=None))
    exp = {r["loyalty_number"]: r["churn_probability"] for r in batch.collect()}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_top_factor_in_pass_equals_long_table(spark):
    from churnlens.operators import explain as EX
    df = _toy(spark)
    vec = VectorAssembler(inputCols=FEATS, outputCol="features").transform(df)
    model = GBTClassifier(labelCol="churn", maxIter=3, maxDepth=3, seed=2).fit(vec)
    values, _ = TS.tree_attribution(model, df, features=FEATS)
    ref = {r["loyalty_number"]: r["top_risk_factor"] for r in EX.top_factor(values).collect()}
    from churnlens.operators import ensemble as EN
    arrays = EN.attribution_arrays(TS.extract_leaves(model, spark)[0], df, FEATS)
    got = {r["loyalty_number"]: r["t"] for r in arrays.select("loyalty_number", EN.top_factor(FEATS).alias("t")).collect()}
    assert got == ref


def test_both_searches_and_the_customer_report_are_plans(spark, monkeypatch):
    from conftest import SF_SMALL

    from churnlens.operators import train as TR
    from churnlens import schemas as S
    from churnlens.plans import all_queries
    asked = []

    def counted(train, valid, trials, **kw):
        # every trial is counted, none fitted: the whole searches take long
        asked.append(list(trials))
        return train.sparkSession.range(len(asked[-1])), {}, None

    monkeypatch.setattr(TR, "search", counted)
    plans = all_queries()
    assert plans["trials_table"](spark, SF_SMALL).count() == S.SEARCH_TRIALS == 30
    assert plans["grid_trials"](spark, SF_SMALL).count() == 16
    assert asked == [list(TR.random_trials()), list(TR.grid_trials())]
    for name, values in S.SEARCH_SPACE.items():
        assert {p[name] for p in asked[0]} == set(values)
    one, = plans["customer_report"](spark, SF_SMALL).collect()
    view, = plans["customer_view"](spark, SF_SMALL).collect()
    assert tuple(one)[:len(view)] == tuple(view)
    for name, plan, order in (("factors", "linear_top_factors", "rank"), ("explanations", "factor_explanations", "rank"),
                              ("waterfall", "waterfall_rows", "position"), ("recommendations", "recommendations", "rank")):
        rows = plans[plan](spark, SF_SMALL).where(F.col("loyalty_number") == view["loyalty_number"]).orderBy(order).collect()
        got = [x.asDict() for x in one[name] or []]
        assert got == [{k: r[k] for k in r.asDict() if k != "loyalty_number"} for r in rows]
