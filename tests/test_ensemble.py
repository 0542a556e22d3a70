"""The relational tree ensemble: scores, counts, shares, attributions and their reductions against plain walks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import ensemble as EN

FEATS = ["a", "b", "c", "d"]
TREES = [("a", 0.1, ("b", -0.2, 0.4, ("a", -0.5, 0.7, -0.3)), ("c", 0.3, -0.6, 0.9)),
         ("b", 0.0, ("a", 0.6, -0.2, 0.5), 0.1),
         0.25]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = [(i, *map(float, np.round(rng.normal(size=4), 3))) for i in range(150)]
    return spark.createDataFrame(data, "loyalty_number long, a double, b double, c double, d double")


def _walk(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _expected(node, x, known, data):
    """Path-dependent expectation of one tree by recursion over the background rows."""
    if not isinstance(node, tuple):
        return node
    f, cut, left, right = node
    if f in known:
        return _expected(left if x[f] <= cut else right, x, known, data_of(data, f, cut, x[f] <= cut))
    lo, hi = data_of(data, f, cut, True), data_of(data, f, cut, False)
    if not data:
        return 0.0
    return (len(lo) * _expected(left, x, known, lo) + len(hi) * _expected(right, x, known, hi)) / len(data)


def data_of(data, f, cut, left):
    return [r for r in data if (r[f] <= cut) == left]


def test_scores_follow_the_trees(spark, rows):
    got = rows.select("*", EN.margin(TREES).alias("m"), EN.probability(TREES).alias("p")).collect()
    for r in got:
        want = sum(_walk(t, r) for t in TREES)
        assert r["m"] == pytest.approx(want, abs=1e-12) and r["p"] == round(1 / (1 + math.exp(-want)), 6)


def test_leaf_table_counts_and_bounds(spark, rows):
    data = rows.collect()
    table = EN.leaf_table(rows, TREES, FEATS).collect()
    leaves = EN.leaves_of(TREES)
    assert [x.value for x in leaves] == [0.4, 0.7, -0.3, -0.6, 0.9, -0.2, 0.5, 0.1, 0.25]
    for t in (0, 1):
        per = {(r["leaf"], r["row_count"]) for r in table if r["tree"] == t}
        assert sum(n for _, n in per) == len(data)
    for r in table:
        own = [x for x in data if all((q["low"] is None or x[q["feature"]] > q["low"]) and (q["high"] is None or x[q["feature"]] <= q["high"])
                                      for q in table if (q["tree"], q["leaf"]) == (r["tree"], r["leaf"]))]
        assert len(own) == r["row_count"]


def test_attributions_equal_brute_force_and_add_up(spark, rows):
    data = rows.collect()
    games, base = EN.games(rows, TREES, FEATS)
    got = EN.attribution_arrays(games, rows, FEATS).orderBy("loyalty_number").collect()
    for r in got:
        assert base + 0.25 * 0 + sum(r["phi"]) == pytest.approx(sum(_walk(t, r) for t in TREES), abs=1e-7)
    m = len(FEATS)
    for r in got[:12]:
        for i, f in enumerate(FEATS):
            others = [g for g in FEATS if g != f]
            total = 0.0
            for k in range(m):
                for some in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    total += w * sum(_expected(t, r, {*some, f}, data) - _expected(t, r, set(some), data) for t in TREES)
            assert r["phi"][i] == pytest.approx(total, abs=1e-8)


def test_reductions_equal_the_long_table(spark, rows):
    from churnlens.operators import explain as EX
    games, _ = EN.games(rows, TREES, FEATS)
    arrays = EN.attribution_arrays(games, rows, FEATS)
    long = EN.long_attributions(arrays, features=FEATS)
    assert long.count() == 4 * rows.count()
    a = {r["feature"]: (r["rank"], round(r["importance"], 9), r["display_name"]) for r in EN.importance(arrays, FEATS).collect()}
    b = {r["feature"]: (r["rank"], round(r["importance"], 9), r["display_name"]) for r in EX.global_importance(long).collect()}
    assert a == b
    tops = {r["loyalty_number"]: r["t"] for r in arrays.select("loyalty_number", EN.top_factor(FEATS).alias("t")).collect()}
    assert tops == {r["loyalty_number"]: r["top_risk_factor"] for r in EX.top_factor(long).collect()}
    ranks = EN.importance(arrays, FEATS)
    x = sorted(map(str, EN.dependence(arrays, ranks, 2, 5, FEATS).collect()))
    y = sorted(map(str, EX.dependence_data(long, ranks, 2, 5).select(*EN.dependence(arrays, ranks, 2, 5, FEATS).columns).collect()))
    assert len(x) == len(y) and [v.split("mean")[0] for v in x] == [v.split("mean")[0] for v in y]


def test_no_rows_are_multiplied_before_an_aggregate(spark, rows):
    games, _ = EN.games(rows, TREES, FEATS)
    plan = EN.importance(EN.attribution_arrays(games, rows, FEATS), FEATS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Aggregate")     # only the one-row result is exploded


def test_empty_background_and_empty_matrix(spark, rows):
    games, base = EN.games(rows.limit(0), TREES, FEATS)
    assert base == 0.25
    assert EN.attribution_arrays(games, rows.limit(0), FEATS).count() == 0


def test_fitted_and_fixed_scorers_stand_in_for_each_other(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    from churnlens.operators import train as TR
    from churnlens import schemas as S
    rng = np.random.default_rng(5)
    data = [(i, *map(float, rng.normal(size=31)), int(rng.integers(0, 2))) for i in range(80)]
    df = spark.createDataFrame(data, ["loyalty_number", *S.FEATURES, "churn"])
    model = Pipeline(stages=[TR.assembler(), GBTClassifier(labelCol="churn", maxIter=2, maxDepth=2, seed=1)]).fit(df)
    for scorer in (EN.Fitted(model, spark), EN.Ensemble(S.FIXTURE_TREES, df)):
        out = scorer.with_top_factor(scorer.predict(df)).collect()
        assert len(out) == 80 and all(0 <= r["churn_probability"] <= 1 and r["top_risk_factor"] in S.FEATURES for r in out)
    fitted = EN.Fitted(model, spark)
    scored = EN.attribution_arrays(fitted.leaves, fitted.predict(df)).withColumn("m", fitted.base + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x))
    assert all(abs(1 / (1 + math.exp(-r["m"])) - r["churn_probability"]) < 1e-6 for r in scored.collect())


def test_patterns_of_a_leaf_are_bits_and_need_no_sort(monkeypatch):
    from churnlens.operators import treeshap as TS
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 9))
    x[0, :] = np.nan

    def games(m, n):
        return [TS.Leaf(np.sort(rng.choice(9, m, replace=False)), rng.normal(size=m) - 1.5, rng.normal(size=m) + 1.5, rng.random(m),
                        float(rng.normal())) for _ in range(n)]

    leaves = [*games(1, 3), *games(3, 5), *games(8, 2)]                 # 256 patterns are more than the rows
    want = np.zeros_like(x)
    for leaf in leaves:
        xs = x[:, leaf.features]
        want[:, leaf.features] += TS.leaf_contributions(leaf.value, leaf.share, ((xs > leaf.lo) & (xs <= leaf.hi)).astype(float))
    assert np.allclose(TS.attributions(leaves, x), want, rtol=0, atol=1e-12)

    def unique(*a, axis=None, **kw):
        raise AssertionError("rows of few patterns are sorted")

    monkeypatch.setattr(TS.np, "unique", unique)
    TS.attributions(leaves[:8], x)
