"""Shallot clustering against plain rounds over every vector and every centroid."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import shallot

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, distance string"


def _plain(rows, k, rounds, seed):
    """``rows`` of (id, integers) → per row (id, cluster, distance), and the last centroids."""
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [list(v) for _, v in sorted(rows, key=mark)[:k]]
    for left in range(rounds, -1, -1):
        dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
        own = [min((dist(v, c), j) for j, c in enumerate(cs)) for _, v in rows]
        if left:
            for j in range(len(cs)):
                mine = [v for (_, v), (_, o) in zip(rows, own) if o == j]
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else cs[j]
    return [(i, o, d) for (i, _), (d, o) in zip(rows, own)], cs


def _check(spark, rows, k, rounds, dims, scale, seed=1):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(3)
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if ok(v)]
    want, cs = _plain(whole, k, rounds, seed)
    got = shallot.cluster(shallot.quantise(df, "vec_id", "embedding", dims, scale), k, rounds, dims, seed).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in got:
        assert r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values())
        assert list(r["centroid"]) == cs[r["cluster"]]
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, [0.1] * 4), (902, [0.1, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    _check(spark, rows, 7, 3, 5, 8, seed)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((a, b) for a in range(-3, 4) for b in range(-3, 4))]
    _check(spark, rows, 9, 4, 2, 1)


def test_few_vectors_one_centroid_and_none(spark):
    _check(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])], 16, 3, 2, 64)
    _check(spark, [(i, [i / 9, -i / 5]) for i in range(20)], 1, 2, 2, 64)
    empty = spark.createDataFrame([], SCHEMA)
    assert shallot.cluster(shallot.quantise(empty, "vec_id", "embedding")).count() == 0


def test_bounds_spare_distances_on_grouped_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [10 * (i % 12) + rng.gauss(0, 0.1), 7 * (i % 5) + rng.gauss(0, 0.1), rng.gauss(0, 0.1)]) for i in range(1200)]
    got = _check(spark, rows, 12, 3, 3, 64)
    assert sum(r["n_measured"] for r in got) < 0.6 * 12 * 4 * len(rows)


def test_far_components_are_set_to_the_end_of_the_range(spark):
    end = int((2 ** 62 / 2) ** 0.5) // 2
    df = spark.createDataFrame([(1, [1e30, -1e30], "", 0, ""), (2, [1.0, 1.0], "", 0, "")], SCHEMA)
    assert shallot.quantise(df, "vec_id", "embedding", 2, 64).orderBy("vec_id").first()["v"] == [end, -end]
    got = shallot.cluster(shallot.quantise(df, "vec_id", "embedding", 2, 64), 1, 1, 2).collect()
    assert all(r["distance"] > 0 for r in got)


def test_the_number_of_centroids_is_bounded(spark):
    with pytest.raises(ValueError):
        shallot.cluster(spark.createDataFrame([], "vec_id long, v array<long>"), shallot.MAX_CENTROIDS + 1)
