"""Shared-pass boosting: splits and leaf values against the rows, limits, company, partitions, prefixes."""

import math

import numpy as np
import pytest

from churnlens.operators import boost as BO
from churnlens.operators import ensemble as EN

FEATS = ["a", "b", "c", "d"]
BASE = dict(n_estimators=3, max_depth=3, learning_rate=0.3, num_leaves=31, min_child_samples=5, subsample=1.0, colsample_bytree=1.0,
            reg_alpha=0.0, reg_lambda=0.0)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600) > 0.4).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i]), 2.0 if y[i] else 1.0) for i in range(600)]
    return spark.createDataFrame(rows, "loyalty_number long, a double, b double, c double, d double, churn int, weight double").cache()


def _fit(train, **kw):
    return BO.fit(train, {**BASE, **kw}, features=FEATS)


def _depth(node):
    return 1 + max(_depth(node[2]), _depth(node[3])) if isinstance(node, tuple) else 0


def _leaves(node):
    return _leaves(node[2]) + _leaves(node[3]) if isinstance(node, tuple) else [node]


def _walk(node, r):
    while isinstance(node, tuple):
        node = node[2] if r[node[0]] <= node[1] else node[3]
    return node


def test_leaf_values_are_newton_steps_with_both_penalties(train):
    rows = train.collect()
    for alpha, lam in ((0.0, 0.0), (1.0, 0.1), (0.1, 5.0)):
        start, tree = _fit(train, n_estimators=1, reg_alpha=alpha, reg_lambda=lam)
        w1 = sum(r["weight"] for r in rows if r["churn"])
        assert start == pytest.approx(math.log(w1 / sum(r["weight"] for r in rows if not r["churn"])))
        p = 1 / (1 + math.exp(-start))
        for value in _leaves(tree):
            own = [r for r in rows if _walk(tree, r) == value]
            g, h = sum(r["weight"] * (p - r["churn"]) for r in own), sum(r["weight"] * p * (1 - p) for r in own)
            want = -math.copysign(max(abs(g) - alpha, 0), g) / (h + lam) * 0.3
            assert value == pytest.approx(want, abs=1e-5) and len(own) >= 5


def test_the_first_split_has_the_largest_gain_of_all(train):
    rows = train.collect()
    start, tree = _fit(train, n_estimators=1, max_depth=1)
    p = 1 / (1 + math.exp(-start))

    def gain(f, cut):
        sides = [[r for r in rows if (r[f] <= cut) == s] for s in (True, False)]
        if min(map(len, sides)) < 5:
            return -1
        part = lambda own: sum(r["weight"] * (p - r["churn"]) for r in own) ** 2 / sum(r["weight"] * p * (1 - p) for r in own)
        return part(sides[0]) + part(sides[1]) - part(rows)

    cuts = dict(zip(FEATS, train.approxQuantile(FEATS, [i / BO.BINS for i in range(1, BO.BINS)], 0.0005)))
    best = max(gain(f, c) for f in FEATS for c in set(cuts[f]))
    assert gain(tree[0], tree[1]) == pytest.approx(best, rel=1e-4)


def test_limits_hold(train):
    for depth in (1, 2, 4):
        assert max(map(_depth, _fit(train, max_depth=depth)[1:])) <= depth
    for leaves in (2, 5):
        trees = _fit(train, max_depth=-1, num_leaves=leaves)[1:]
        assert max(len(_leaves(t)) for t in trees) == leaves
    deep = _fit(train, max_depth=-1, num_leaves=127, min_child_samples=2)[1:]
    assert max(map(_depth, deep)) > 5
    assert {t[0] for t in _fit(train, n_estimators=8, max_depth=1, colsample_bytree=0.25)[1:]} != {"a"}


def test_partitions_and_company_change_nothing(spark, train):
    p = dict(subsample=0.7, colsample_bytree=0.7, n_estimators=6)
    alone, capped = _fit(train, **p), _fit(train, **{**p, "num_leaves": 5, "max_depth": -1})
    assert _fit(train.repartition(5), **p) == alone
    rows = BO.ROWS
    try:
        BO.ROWS = 100                                                   # several blocks
        assert _fit(train, **p) == alone
    finally:
        BO.ROWS = rows
    others = [{**BASE, "max_depth": 2, "n_estimators": 9}, {**BASE, **p}, {**BASE, **p, "reg_lambda": 3.0}]
    session = BO.fit_all(train, None, others, features=FEATS, every=4)
    session.close()
    assert session.trees({**BASE, **p}) == alone
    assert session.passes <= 9 + 1                                      # the longest fit's passes serve all
    small = BO.SMALL
    try:
        for BO.SMALL in (0, 40, 200):                                   # nodes in histograms, some or all
            assert _fit(train, **p) == alone
            assert _fit(train, **{**p, "num_leaves": 5, "max_depth": -1}) == capped
    finally:
        BO.SMALL = small


def test_sizes_of_one_fit_are_its_prefixes_and_scores_follow_the_trees(spark, train):
    valid = train.limit(80)
    seen = {}

    def note(session, scores):
        for r in scores.collect():
            seen.setdefault((r["model"], r["n_trees"]), []).append((r["churn"], r["churn_probability"]))

    sets = [{**BASE, "n_estimators": n} for n in (1, 4, 7)] + [{**BASE, "max_depth": 2, "n_estimators": 5}]
    session = BO.fit_all(train, valid, sets, note, features=FEATS, every=5)
    session.close()
    assert sorted(seen) == [(0, 1), (0, 4), (0, 7), (1, 5)]
    assert session.trees(sets[1]) == session.trees(sets[2])[:5] == _fit(train, n_estimators=4)
    for (m, n), rows in seen.items():
        trees = session.trees(sets[3] if m else {**BASE, "n_estimators": n})
        want = sorted((r["churn"], round(1 / (1 + math.exp(-sum(_walk(t, r) for t in trees))), 9)) for r in valid.collect())
        assert sorted((c, round(p, 9)) for c, p in rows) == want


def test_boosting_learns(spark, train):
    from churnlens.operators import evaluate as EV
    short, long = _fit(train, n_estimators=2), _fit(train, n_estimators=25)
    loss = lambda trees: sum(r["weight"] * -math.log(q if r["churn"] else 1 - q) for r in train.collect()
                             for q in [1 / (1 + math.exp(-sum(_walk(t, r) for t in trees)))])
    assert loss(long) < 0.8 * loss(short)
    scored = EN.score(train, long, FEATS)
    assert EV.auc_summary(scored).first()["roc_auc"] > 0.9


def test_long_ensembles_score_and_count_as_short_ones(spark, train, monkeypatch):
    trees = _fit(train, n_estimators=5)
    native = EN.score(train, trees, FEATS).select("loyalty_number", "churn_probability").orderBy("loyalty_number").collect()
    counts = EN.row_counts(train, trees, FEATS)
    monkeypatch.setattr(EN, "NATIVE_LEAVES", 3)
    assert EN.score(train, trees, FEATS).select("loyalty_number", "churn_probability").orderBy("loyalty_number").collect() == native
    assert EN.row_counts(train, trees, FEATS) == counts


def test_node_table_round_trip(spark, train, tmp_path):
    trees = _fit(train)
    EN.write_trees(spark, trees, str(tmp_path / "trees"))
    assert EN.read_trees(spark, str(tmp_path / "trees")) == trees


def test_a_small_table_needs_one_pass_and_gets_the_trees_of_the_levels(train):
    valid = train.where("loyalty_number % 5 = 0")
    sets = [{**BASE, "n_estimators": n, "subsample": 0.7, "colsample_bytree": 0.75} for n in (2, 6)]
    sets += [{**BASE, "max_depth": -1, "num_leaves": 5, "n_estimators": 12}, {**BASE, "reg_alpha": 1.0, "min_child_samples": 40}]

    def run():
        scores = []
        session = BO.fit_all(train, valid, sets, lambda s, rows: scores.extend(map(tuple, rows.collect())), features=FEATS, every=3)
        session.close()
        return session.passes, [session.trees(p) for p in sets], sorted(scores)

    passes, trees, scores = run()
    assert passes == 1 and len(scores) == 4 * valid.count()
    rows, small, whole = BO.ROWS, BO.SMALL, BO.WHOLE
    try:
        BO.ROWS = 100
        assert run() == (1, trees, scores)                              # several blocks become one copy
        BO.WHOLE = 0
        for BO.SMALL in (0, 40, 200, small):                            # nodes in histograms, some or all
            levels, same, also = run()
            assert levels >= 12 and same == trees
            assert [r[:3] for r in also] == [r[:3] for r in scores]
            assert np.allclose([r[3] for r in also], [r[3] for r in scores], rtol=0, atol=1e-12)
    finally:
        BO.ROWS, BO.SMALL, BO.WHOLE = rows, small, whole


def test_a_partition_is_one_block_whatever_the_batches(spark, train, monkeypatch):
    monkeypatch.setattr(BO, "WHOLE", 0)
    monkeypatch.setattr(BO, "ROWS", 4000)                               # 600 rows: three blocks, if there are as many cores
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        session = BO.Session(train, None, [BASE], "churn", "loyalty_number", FEATS, 1, 8)
        sizes = session.blocks.map(lambda b: len(b["y"])).collect()
        session.close()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(sizes) == 600 and len(sizes) == min(3, spark.sparkContext.defaultParallelism)


def test_more_partitions_than_fits_change_nothing(train, monkeypatch):
    from pyspark import RDD
    real = RDD.partitionBy
    sets = [BASE, {**BASE, "max_depth": 2}]
    want = [_fit(train, **p) for p in sets]
    for n in (1, 7):
        monkeypatch.setattr(RDD, "partitionBy", lambda self, _, f: real(self, n, f))    # noqa: B023
        session = BO.fit_all(train, None, sets, features=FEATS)
        session.close()
        assert [session.trees(p) for p in sets] == want


@pytest.mark.parametrize("weight", [1.0, 1e3])
def test_rows_are_added_up_once_for_several_features(weight, monkeypatch):
    rng = np.random.default_rng(5)
    bins = [32, 32, 2, 2, 5, 1, 32, 3]
    x = np.stack([rng.integers(0, b, 30_000) for b in bins]).astype(np.uint8).T
    x[0] = [b - 1 for b in bins]
    g, h = np.rint(rng.normal(size=len(x)) * weight * BO._UNIT), np.rint(rng.random(len(x)) * weight * BO._UNIT)
    groups = BO._joined(x)
    assert sorted(f for fs, _, _ in groups for f in fs) == list(range(8)) and len(groups) == 3
    features, calls, real = np.array([0, 2, 3, 4, 6, 7]), [], BO._added
    monkeypatch.setattr(BO, "_added", lambda columns, *rest: calls.append(len(columns)) or real(columns, *rest))
    for sizes in ([30_000], [9_000, 0, 12_000], [40] * 9):              # many rows a node, or few
        at = np.split(rng.permutation(len(x))[:sum(sizes)], np.cumsum(sizes)[:-1])
        got = BO._node_sums(x, groups, at, features, g, h)
        for i, rows in enumerate(at):
            for j, f in enumerate(features):
                for k, values in enumerate((g, h, np.ones(len(x)))):
                    want = np.zeros(BO.BINS, np.int64)
                    np.add.at(want, x[rows, f], values[rows].astype(np.int64))
                    assert (got[k, i, j] == want).all()
    assert calls == [3, 3, 6]


def _levels(train, monkeypatch, **kw):
    monkeypatch.setattr(BO, "WHOLE", 0)
    monkeypatch.setattr(BO, "SMALL", 0)                                 # all nodes in histograms
    return BO.Session(train, None, [{**BASE, **kw}], "churn", "loyalty_number", FEATS, 1, 8)


def test_features_of_a_block_lie_column_by_column(train, monkeypatch):
    session = _levels(train, monkeypatch)
    assert all(session.blocks.map(lambda b: b["x"].flags.f_contiguous).collect())
    session.close()


def test_few_histograms_need_no_shuffle(train, monkeypatch):
    from pyspark import RDD
    want = _fit(train, n_estimators=5, subsample=0.7)
    _levels(train, monkeypatch).close()
    keys = []
    real = RDD.reduceByKey
    monkeypatch.setattr(RDD, "reduceByKey", lambda *a, **kw: keys.append(1) or real(*a, **kw))
    assert _fit(train, n_estimators=5, subsample=0.7) == want and not keys
    monkeypatch.setattr(BO, "DIRECT", 0)
    assert _fit(train, n_estimators=5, subsample=0.7) == want and len(keys) == 15


def test_the_smaller_of_two_children_is_asked_for(train, monkeypatch):
    session = _levels(train, monkeypatch, max_depth=3)
    session.one_pass()
    fit = session.fits[0]
    nodes, small, left = session._asked(0)
    assert fit.wanted() == [1, 2] and len(nodes) == 1 and list(left) == [3 - nodes[0]] and left[3 - nodes[0]] == (0, nodes[0])
    assert fit.rows[nodes[0]] <= fit.rows[3 - nodes[0]] and not small.any()
    monkeypatch.setattr(BO, "SMALL", 600)
    assert session._asked(0)[1].all() and len(session._asked(0)[0]) == 2   # their children's splits are found with theirs
    session.one_pass()
    session.close()


def test_blocks_are_checkpointed_now_and_then(train, monkeypatch):
    want = _fit(train, n_estimators=4)
    _levels(train, monkeypatch).close()
    for keep, times in ((1, 12), (5, 2), (50, 0)):
        monkeypatch.setattr(BO, "KEEP", keep)
        dropped, real = [], BO.Session._drop_checkpoint
        monkeypatch.setattr(BO.Session, "_drop_checkpoint", lambda self, rdd: dropped.append(rdd is not None) or real(self, rdd))  # noqa: B023
        assert BO.fit(train, {**BASE, "n_estimators": 4}, features=FEATS, every=1) == want
        monkeypatch.setattr(BO.Session, "_drop_checkpoint", real)
        assert sum(dropped) == times


def test_leaves_of_small_and_large_trees(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 32, (500, 4)).astype(np.uint8)
    feature, cut, left, right = (np.array(a) for a in ([2, 0, -1, 3, -1, -1, -1], [9, 20, 0, 4, 0, 0, 0], [1, 3, 0, 5, 0, 0, 0], [2, 4, 0, 6, 0, 0, 0]))
    arrays = feature, cut, left, right, np.zeros(7)
    at = rng.permutation(500)[:90]
    few = BO.leaf_of(arrays, 3, x), BO.leaf_of(arrays, 3, x, at)
    monkeypatch.setattr(BO, "FEW", 0)
    assert (few[0] == BO.leaf_of(arrays, 3, x)).all() and (few[1] == BO.leaf_of(arrays, 3, x, at)).all()
    assert set(few[0].tolist()) == {2, 4, 5, 6}


def test_many_fits_of_a_larger_table_are_a_task_each(train, monkeypatch):
    sets = [{**BASE, "reg_lambda": float(i)} for i in range(-(-train.sparkSession.sparkContext.defaultParallelism // 2))]
    want = [_fit(train, **p) for p in sets]
    monkeypatch.setattr(BO, "WHOLE", 100)                               # of 600 rows
    session = BO.fit_all(train, None, sets, features=FEATS)
    session.close()
    assert session.passes == 1 and [session.trees(p) for p in sets] == want
    session = BO.fit_all(train, None, sets[:1], features=FEATS)
    session.close()
    assert session.trees(sets[0]) == want[0] and (session.passes > 1 or len(sets) == 1)
    monkeypatch.setattr(BO, "WHOLE", 70)                                # too many rows for a task
    session = BO.fit_all(train, None, sets, features=FEATS)
    session.close()
    assert session.passes > 1 and [session.trees(p) for p in sets] == want


@pytest.mark.parametrize("weight", [1.0, 1e3, 1e5])
def test_one_addition_does_for_gradient_hessian_and_count(weight):
    rng = np.random.default_rng(6)
    x = np.asfortranarray(np.stack([rng.integers(0, b, 40_000) for b in (32, 32, 3, 32, 1, 7)], axis=1).astype(np.uint8))
    y, w, margin = (rng.random(len(x)) < 0.3).astype(float), np.where(rng.random(len(x)) < 0.3, weight, 1.0), rng.normal(size=len(x))
    weights = BO._Weights(x, y, w, BO._groups(x))
    weights.renew(margin)
    g, h = BO._derivatives(y, w, margin)
    features = np.array([0, 2, 3, 5])
    rows = np.split(rng.permutation(len(x)).astype(np.int32)[:36_000], [17_000, 17_000, 17_900, 30_000])   # many, none, few
    got = weights.sums(rows, features)
    assert weights.counted == (weight < 1e5)
    for i, at in enumerate(rows):
        for j, f in enumerate(features):
            for k, values in enumerate((g, h, np.ones(len(x)))):
                want = np.zeros(BO.BINS, np.int64)
                np.add.at(want, x[at, f], values[at].astype(np.int64))
                assert (got[k, i, j] == want).all()


def test_rows_of_a_leaf_side_by_side_change_nothing(train, monkeypatch):
    valid = train.where("loyalty_number % 5 = 0")
    sets = [{**BASE, "n_estimators": n, "subsample": 0.7, "colsample_bytree": 0.75} for n in (1, 6)]

    def run():
        scores = []
        session = BO.fit_all(train, valid, sets, lambda s, rows: scores.extend(map(tuple, rows.collect())), features=FEATS)
        session.close()
        return session.trees(sets[1]), sorted(scores)

    want = run()
    moved, real = [], BO._Weights.reorder
    monkeypatch.setattr(BO, "CACHED", 0)
    assert run() == want
    x, y = np.asfortranarray(np.arange(12, dtype=np.uint8).reshape(6, 2)), np.array([0, 1, 0, 1, 1, 0.0])
    monkeypatch.setattr(BO._Weights, "reorder", lambda self, order: moved.append(len(order)) or real(self, order))
    block = {"x": x, "y": y, "w": np.ones(6), "rows": np.arange(6).astype(np.uint64), "trained": 5, "margins": np.zeros((1, 6))}
    BO._grow_fit(block, 0, {**BASE, "min_child_samples": 1}, 1, {3}, 2)
    assert moved == [5]


def test_rows_part_at_a_cut_in_their_order():
    rng = np.random.default_rng(9)
    column, at = rng.integers(0, 32, 50_000).astype(np.uint8), np.sort(rng.permutation(50_000)[:30_000]).astype(np.int32)
    for cut in (0, 11, 31):
        low, high = BO._parted(column, cut, at)
        assert (low == at[column[at] <= cut]).all() and (high == at[column[at] > cut]).all()
    flags = rng.random(50_000) < 0.4
    assert (BO._numbers(flags) == np.flatnonzero(flags)).all()
