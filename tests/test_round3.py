"""Prefix-shared search, pruned neighbours, prefix scans, percent ranks and the exact split."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnlens import schemas as S
from churnlens.operators import evaluate as EV
from churnlens.operators import ranking as RK
from churnlens.operators import resample as RS
from churnlens.operators import split as SP
from churnlens.operators import train as TR


# ------------------------------------------------------------------ search
@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 31))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=300) > 0).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, ["loyalty_number", *S.FEATURES, "churn", "weight"])
    return df.where("loyalty_number < 200").cache(), df.where("loyalty_number >= 200").cache()


def _trial(**kw):
    return {**{k: v[0] for k, v in S.SEARCH_SPACE.items()}, "n_estimators": 2, **kw}


def _trial(**kw):
    return {**{k: v[0] for k, v in S.SEARCH_SPACE.items()}, "n_estimators": 2, **kw}


def test_trials_share_fits_and_a_rerun_goes_on(spark, labelled, tmp_path, monkeypatch):
    from churnlens.operators import boost as BO
    from churnlens.operators import ensemble as EN
    train, valid = labelled
    asked = []
    real = BO.fit_all
    monkeypatch.setattr(BO, "fit_all", lambda t, v, sets, *a, **kw: asked.append(len(sets)) or real(t, v, sets, *a, **kw))
    trials = [_trial(), _trial(n_estimators=4), _trial(num_leaves=127, max_depth=-1, reg_alpha=1.0), _trial(max_depth=5, n_estimators=3), _trial(n_estimators=4)]
    ledger = str(tmp_path / "ledger")
    table, best, trees = TR.search(train, valid, trials[:3], ledger=ledger)
    first = table.orderBy("trial").collect()
    assert len({r["fit"] for r in first}) == 2 and len(trees) == best["n_estimators"] + 1
    whole, best, trees = TR.search(train, valid, trials, ledger=ledger)
    assert asked == [3, 1]                                              # only what the ledger lacks
    rows = whole.orderBy("trial").collect()
    assert rows[:3] == first and len(rows) == 5
    assert rows[1]["validation_f1"] == rows[4]["validation_f1"]
    alone = EN.Ensemble(BO.fit(train, trials[1]), train)
    f1, threshold = TR.validation_f1(alone, valid)
    assert rows[1]["validation_f1"] == pytest.approx(f1) and rows[1]["threshold"] == pytest.approx(threshold, abs=1e-6)
    top = max(rows, key=lambda r: (r["validation_f1"], -r["trial"]))
    assert best == trials[top["trial"]]
    asked.clear()
    again, _, none = TR.search(train, valid, trials, ledger=ledger)
    assert asked == [] and none is None and again.orderBy("trial").collect() == rows


def test_an_unfinished_table_is_not_taken_from_the_ledger(spark, labelled, tmp_path):
    train, valid = labelled
    ledger = tmp_path / "ledger"
    TR.search(train, valid, [_trial()], ledger=str(ledger))
    part, = ledger.iterdir()
    (part / "_SUCCESS").unlink()
    assert TR._ledger_rows(spark, str(ledger)) == {}
    table, _, _ = TR.search(train, valid, [_trial()], ledger=str(ledger))
    assert table.count() == 1


def test_best_thresholds_of_many_models_equal_one_by_one(spark):
    rng = random.Random(7)
    rows = [(m, rng.randint(0, 1) if m < 4 else 0, rng.randint(0, 30) / 30) for m in range(5) for _ in range(60)]
    df = spark.createDataFrame(rows, "model int, churn int, churn_probability double")
    got = {r["model"]: (r["threshold"], round(r["f1"], 12)) for r in EV.best_f1_thresholds(df, ["model"]).collect()}
    for m in range(4):
        one = df.where(F.col("model") == m)
        best = EV.best_f1_threshold(one)
        f1 = EV.threshold_metrics(one, best.select("threshold")).first()["f1"]
        assert got[m] == (best.first()["threshold"], round(f1, 12))
    assert got[4][1] == 0


# ------------------------------------------------------------------ neighbours
def _brute(rows, k):
    out = {}
    for key, x in rows:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), other) for other, y in rows if other != key)
        out[key] = [n for _, n in near[:k]]
    return out


@pytest.mark.parametrize("seed,pivots,block", [(1, None, 2048), (2, 3, 7), (3, 40, 5), (4, 1, 16)])
def test_pruned_neighbours_equal_brute_force(spark, seed, pivots, block):
    rng = random.Random(seed)
    rows = [(i, tuple(float(rng.randint(0, 12)) for _ in range(3))) for i in range(220)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, (1e6, 0.0, 0.0)), (2001, (-1e6, 5.0, 5.0))]
    df = spark.createDataFrame([(i, *x) for i, x in rows], "loyalty_number long, a double, b double, c double")
    got = {r["loyalty_number"]: r["neighbors"] for r in RS.nearest_neighbors(df, ["a", "b", "c"], 5, block_rows=block, pivots=pivots).collect()}
    assert got == _brute(rows, 5)


def test_most_pairs_are_never_met(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3)) * [100, 10, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "point long, x array<double>")
    found, sent = RS.nearest_points(df, 5)
    celled, _ = RS.pivot_cells(df)
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    met = sum(r["count"] * sizes[r["cell"]] for r in sent.groupBy("cell").count().collect()) + sum(n * n for n in sizes.values())
    assert met < 0.35 * 3000 ** 2
    assert found.count() == 5 * 3000


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0)], "loyalty_number long, a double")
    got = {r["loyalty_number"]: r["neighbors"] for r in RS.nearest_neighbors(df, ["a"], 5).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    with pytest.raises(ValueError):
        RS.nearest_neighbors(df.limit(1), ["a"], 5)


# ------------------------------------------------------------------ prefix scans
@pytest.fixture(params=[0, 100_000])
def one_task(request, monkeypatch):
    """Every scan by partitions, and small ones in one window."""
    monkeypatch.setattr(RK, "ONE_TASK", request.param)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_totals_start_anew_in_groups(spark, one_task, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "x", "y", "z"]), float(v), rng.randint(-5, 9), rng.randint(0, 3)) for v in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, n long, m int")
    got = RK.running_totals(df, "v", ["n", "m"], buckets=parts, by=["g"]).collect()
    pdf = pd.DataFrame(rows, columns=["g", "v", "n", "m"]).fillna({"g": "none"}).sort_values("v")
    want = {v: (a, b) for v, a, b in zip(pdf.v, pdf.groupby("g").n.cumsum(), pdf.groupby("g").m.cumsum())}
    assert {r["v"]: (r["cum_n"], r["cum_m"]) for r in got} == want


def test_equal_values_in_the_order_of_further_columns(spark, one_task):
    df = spark.createDataFrame([(1, k, 1) for k in range(50)], "v int, k int, n int")
    got = {r["k"]: r["cum_n"] for r in RK.running_totals(df, "v", ["n"], then=["k"], buckets=4).collect()}
    assert got == {k: k + 1 for k in range(50)}


def test_percent_ranks_of_groups(spark, one_task):
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, 20)), i) for i, g in enumerate("aaabbbbbbbbbbbbcccccccccccccccccccccccc")] + [("one", 3.0, 99), (None, 1.0, 100), (None, 4.0, 101)]
    got = RK.percent_ranks(spark.createDataFrame(rows, "g string, v double, i int"), "v", ["g"]).collect()
    pdf = pd.DataFrame(rows, columns=["g", "v", "i"]).fillna({"g": "none"})
    n = pdf.groupby("g").v.transform("size")
    want = dict(zip(pdf.i, (pdf.groupby("g").v.rank(method="min") - 1) / (n - 1).clip(lower=1)))
    assert {r["i"]: round(r["percent_rank"], 12) for r in got} == {i: round(v, 12) for i, v in want.items()}


def test_a_curve_takes_one_range_shuffle_and_no_cut_lambda(spark, monkeypatch):
    monkeypatch.setattr(RK, "ONE_TASK", 0)
    df = spark.range(500).select((F.col("id") % 2).alias("churn"), (F.col("id") / 500).alias("churn_probability"))
    plan = EV.score_curve(df)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "percentile" not in plan
    # scanned once and written: only the partitions' totals are still to be exchanged
    main = plan.split("Subquery")[0]
    assert "rangepartitioning" not in main and "hashpartitioning(threshold" not in main and main.count("Window") <= 1


# ------------------------------------------------------------------ split
def test_the_stored_sizes_of_the_original_follow_from_the_rule():
    n = 16737
    test = math.ceil(S.TEST_SHARE * n)
    validation = math.ceil(S.VALIDATION_SHARE * (n - test))
    assert (test, validation, n - test - validation) == (2511, 2504, 11722)
    assert sum(SP.stratified({0: 13870, 1: 2867}, S.TEST_SHARE).values()) == 2511
    assert SP.stratified({0: 13870, 1: 2867}, S.TEST_SHARE)[1] == 430    # the stored labels hold 430 churned


@pytest.mark.parametrize("n", [7, 400, 5000])
def test_the_split_is_exact_per_class_and_by_smallest_hash(spark, n):
    import hashlib
    df = spark.range(n).select(F.col("id").alias("loyalty_number"), (F.col("id") % 5 == 0).cast("int").alias("churn"))
    got = {r["loyalty_number"]: r["split"] for r in SP.assign_split(df).collect()}
    sizes = {c: sum(1 for i in range(n) if int(i % 5 == 0) == c) for c in (0, 1)}
    take = SP.stratified(sizes, S.TEST_SHARE)
    left = SP.stratified({c: sizes[c] - take[c] for c in sizes}, S.VALIDATION_SHARE)
    md5 = lambda i, part: hashlib.md5(f"{i}-42{part}".encode()).hexdigest()
    for c in (0, 1):
        ids = sorted((i for i in range(n) if int(i % 5 == 0) == c), key=lambda i: md5(i, ""))
        rest = sorted(ids[take[c]:], key=lambda i: md5(i, "-val"))
        assert {got[i] for i in ids[:take[c]]} <= {"test"}
        assert {got[i] for i in rest[:left[c]]} <= {"validation"} and {got[i] for i in rest[left[c]:]} <= {"train"}


def test_split_of_an_empty_table_and_of_null_labels(spark):
    df = spark.createDataFrame([], "loyalty_number long, churn int")
    assert SP.assign_split(df).count() == 0
    some = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "loyalty_number long, churn int")
    counts = {(r["churn"], r["split"]): r["count"] for r in SP.assign_split(some).groupBy("churn", "split").count().collect()}
    assert counts[None, "test"] == counts[1, "test"] == 3


def test_only_pairs_within_reach_are_measured(monkeypatch):
    import pyarrow as pa

    from churnlens.operators import resample as RS
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 5)), 1) * [1, 1, 1, 1, 1e5]
    x[200:240] = x[:40]                                                 # equal points
    ids = rng.permutation(900).astype(np.int64)
    want = {}
    for i in range(900):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want[ids[i]] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if j != i][:4]
    pairs, real = [], RS._distance
    monkeypatch.setattr(RS, "_distance", lambda a, b: pairs.append(len(a)) or real(a, b))
    held = pa.table({"point": ids, "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    def solve(reach):
        asks = pa.table({"q_point": ids, "q_x": held["x"], "q_reach": pa.array(reach, pa.float64())})
        got = {}
        for r in RS._solve(None, asks, held, 4).to_pylist():
            got.setdefault(r["point"], []).append((r["near"], r["dist"]))
        return got

    assert solve([None] * 900) == want
    reach = [want[i][1][1] for i in ids]                                # that of the second neighbour: it counts, equal ones too
    assert solve(reach) == {i: [n for n in near if n[1] <= near[1][1]] for i, near in want.items()}
    assert sum(pairs) < 900 * 900 / 20
