"""Distributed order statistics and evaluation against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.operators import evaluate as EV
from churnlens.operators import ranking as RK


def _labels_scores(seed, n=300):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 2)       # many ties
    return y, s


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_running_totals_match_cumsum(spark, monkeypatch, one_task):
    monkeypatch.setattr(RK, "ONE_TASK", one_task)
    rng = np.random.default_rng(1)
    vals = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "v double, w long")
    for desc in (False, True):
        got = {r["v"]: r["cum_w"] for r in RK.running_totals(df, "v", ["w"], descending=desc, buckets=7).collect()}
        order = np.argsort(-vals if desc else vals)
        exp = dict(zip(vals[order], np.cumsum(w[order])))
        assert got == exp


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_exact_median(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert RK.exact_median(df, "x").first()["median"] == float(np.median(xs))


def test_order_statistics_refine_to_the_exact_values(spark, monkeypatch):
    rng = np.random.default_rng(6)
    xs = np.concatenate([rng.lognormal(0, 12, 400), -rng.lognormal(0, 12, 200), [0.0] * 60, [1e300, -1e300, 5e-324]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double").repartition(3)
    ordered = sorted(xs)
    for cells in (64, 4096):
        monkeypatch.setattr(RK, "CELLS", cells)
        wanted = [1, 300, 332, len(xs)]
        assert RK.order_statistics(df, "x", lambda n: wanted) == [ordered[r - 1] for r in wanted]
    assert RK.exact_median(df.limit(0), "x").first()["median"] is None


def test_auc_ap_and_best_threshold_brute_force(spark):
    y, s = _labels_scores(3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "churn int, churn_probability double")
    got = EV.auc_summary(df).first()
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got["roc_auc"] - mw) < 1e-12
    ths = np.unique(s)[::-1]
    ap, prev_r, best = 0.0, 0.0, (-1, None)
    for t in ths:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        p, r = tp / (tp + fp), tp / (y == 1).sum()
        ap += (r - prev_r) * p
        prev_r = r
        f1 = 2 * (p * r) / (p + r + 1e-10)
        if f1 >= best[0]:
            best = (f1, t)
    assert abs(got["average_precision"] - ap) < 1e-12
    b = EV.best_f1_threshold(df).first()
    assert b["threshold"] == best[1]


def test_sweep_and_confusion_consistent(spark):
    y, s = _labels_scores(5)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "churn int, churn_probability double")
    sweep = EV.threshold_sweep(df).orderBy("threshold").collect()
    assert len(sweep) == 16
    recalls = [r["recall"] for r in sweep]
    assert all(a >= b for a, b in zip(recalls, recalls[1:]))                 # recall non-increasing
    t = sweep[4]["threshold"]
    c = EV.confusion_counts(df, t).first()
    assert (c["tp"], c["fp"]) == (sweep[4]["tp"], sweep[4]["fp"])
    cells = EV.confusion_matrix(df, t).collect()
    assert sum(r["count"] for r in cells) == len(y)
    rep = {r["class"]: r for r in EV.class_report(df, t).collect()}
    assert rep["1"]["support"] == int((y == 1).sum()) and rep["0"]["support"] == int((y == 0).sum())
