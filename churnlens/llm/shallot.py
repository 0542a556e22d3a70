"""Exact centroid clustering of integer vectors with Shallot search.

Borgelt, "Even Faster Exact k-Means Clustering" (2020).  Every vector keeps its nearest and its
second-nearest centroid, an upper bound of its distance to the first and a lower bound of its distance to
any other.  When the centroids have moved, the bounds move with them; a vector whose bounds still part
needs no distance at all.  The others measure the two remembered centroids and scan from the closer one:
its neighbours come sorted by distance, and the scan ends where a neighbour lies beyond the distance to
the start plus the distance to the second-nearest found so far, a ball that shrinks with every better one.
What survives is compared in integers: squared distances are exact, bounds are rounded outwards, so ties
go to the smaller centroid number for certain.

The centroids (bounded by ``MAX_CENTROIDS`` and ``MAX_CELLS``) travel with the tasks.  A round is one pass
without a shuffle that writes vectors and bounds, and one of partial sums per task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare_python

#: Bounds on what is sent to every task: centroids, and numbers in all of them.
MAX_CENTROIDS, MAX_CELLS = 2048, 1 << 22
#: Relative width by which square roots are rounded outwards.
_SLACK = 2.0 ** -48
_STATE = "vec_id long, v array<long>, cluster int, second int, upper double, lower double, distance long, n_measured int"


def quantise(df: DataFrame, id_col: str, vec_col: str, dims: int = 64, scale: int = 64) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component of the vectors with exactly ``dims`` valid ones.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.  Components
    beyond the range in which every squared distance fits 64 bits (2**27 for 64 dimensions) are set to its end.
    """
    x = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    end = int((2 ** 62 / dims) ** 0.5) // 2
    whole = lambda c: F.greatest(F.least(F.floor(F.lit(scale) * c.cast("double")), F.lit(end)), F.lit(-end))
    return (df.where(x.isNotNull() & (F.size(x) == dims) & ~F.coalesce(F.exists(x, bad), F.lit(True)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v")))


def _up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + _SLACK)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - _SLACK)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids with what the search needs of them: safe gaps and each one's neighbours by distance."""

    def __init__(self, at: np.ndarray, before: "Centroids | None" = None):
        self.at, self.k = at, len(at)
        gaps = np.stack([_squared(at, np.broadcast_to(c, at.shape)) for c in at])
        np.fill_diagonal(gaps, -1)                                     # each one first among its own neighbours
        self.near = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        np.fill_diagonal(gaps, 0)
        self.gap = _down(gaps)
        own = np.arange(self.k)
        self.half = self.gap[own, self.near[:, 0]] / 2 if self.k > 1 else np.full(1, np.inf)
        self.moved = _up(_squared(at, before.at)) if before is not None else None

    def others_moved(self) -> np.ndarray:
        """For each centroid the farthest move of any other."""
        if self.k == 1:
            return np.zeros(1)
        most = np.argsort(self.moved)
        out = np.full(self.k, self.moved[most[-1]])
        out[most[-1]] = self.moved[most[-2]]
        return out


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, cs: Centroids):
    """The two nearest centroids of every row, their squared distances, and how many were measured.

    ``first`` and ``second`` are the remembered ones; they only decide where the scan starts.
    """
    best, runner = first.copy(), second.copy()
    d1, d2 = _squared(x, cs.at[best]), _squared(x, cs.at[runner])
    turn = (d2 < d1) | (d2 == d1) & (runner < best)
    best[turn], runner[turn] = runner[turn], best[turn]
    d1[turn], d2[turn] = d2[turn], d1[turn]
    start, reach = best.copy(), _up(d1)
    known = (first, second)
    measured = np.full(len(x), 2)
    live = np.arange(len(x))
    for j in range(cs.k - 1):
        other = cs.near[start[live], j]
        inside = cs.gap[start[live], other] <= (reach[live] + _up(d2[live])) * (1 + _SLACK)
        live, other = live[inside], other[inside]
        if not len(live):
            break
        new = (other != known[0][live]) & (other != known[1][live])
        rows, o = live[new], other[new]
        d = _squared(x[rows], cs.at[o])
        measured[rows] += 1
        ahead = (d < d1[rows]) | (d == d1[rows]) & (o < best[rows])
        behind = ~ahead & ((d < d2[rows]) | (d == d2[rows]) & (o < runner[rows]))
        r = rows[ahead]
        runner[r], d2[r], best[r], d1[r] = best[r], d1[r], o[ahead], d[ahead]
        r = rows[behind]
        runner[r], d2[r] = o[behind], d[behind]
    return best, d1, runner, d2, measured


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assign_batches(batches, cs: Centroids, last: bool):
    """Vectors with their nearest centroid; without bounds yet if the batch has only ids and vectors."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        x = _matrix(b.column(1), cs.at.shape[1])
        if cs.k == 1:
            d = _squared(x, cs.at[np.zeros(n, np.int64)])
            best = runner = np.zeros(n, np.int64)
            upper, lower, total = _up(d), np.full(n, np.inf), np.ones(n, np.int64)
        elif b.num_columns == 2:
            best, d, runner, d2, total = search(x, np.zeros(n, np.int64), np.ones(n, np.int64), cs)
            upper, lower = _up(d), _down(d2)
        else:
            best, runner = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            upper = (b.column(4).to_numpy() + cs.moved[best]) * (1 + _SLACK)
            lower = (b.column(5).to_numpy() - cs.others_moved()[best]) * (1 - _SLACK)
            lower = np.where(lower > 0, lower, 0)
            total, d = b.column(7).to_numpy().astype(np.int64), np.zeros(n, np.int64)
            apart = np.maximum(lower, cs.half[best] * (1 - _SLACK))
            open_ = np.arange(n) if last else np.flatnonzero(upper >= apart)     # the last pass returns distances
            d[open_] = _squared(x[open_], cs.at[best[open_]])
            upper[open_] = _up(d[open_])
            total[open_] += 1
            open_ = open_[upper[open_] >= apart[open_]]
            if len(open_):
                f, d1, s, d2, m = search(x[open_], best[open_], runner[open_], cs)
                best[open_], d[open_], runner[open_], total[open_] = f, d1, s, total[open_] + m - 1
                upper[open_], lower[open_] = _up(d1), _down(d2)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(runner, pa.int32()), pa.array(upper),
             pa.array(lower), pa.array(d), pa.array(total, pa.int32())],
            names=["vec_id", "v", "cluster", "second", "upper", "lower", "distance", "n_measured"])


def _sum_batches(batches, k: int, dims: int):
    """Per task one row for each centroid that has vectors: their number and their componentwise sum."""
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for b in batches:
        x, of = _matrix(b.column(0), dims), b.column(1).to_numpy()
        order = np.argsort(of, kind="stable")
        which, at = np.unique(of[order], return_index=True)
        if len(which):
            total[which] += np.add.reduceat(x[order], at, axis=0)
            count += np.bincount(of, minlength=k)
    has = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(has, pa.int32()), pa.array(count[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))],
        names=["cluster", "n", "total"])


def _moved(state: DataFrame, cs: Centroids) -> Centroids:
    """The centroids as the exact floor of their vectors' mean; those without vectors stay."""
    dims = cs.at.shape[1]
    parts = state.select("v", "cluster").mapInArrow(partial(_sum_batches, k=cs.k, dims=dims), "cluster int, n long, total array<long>")
    sums = (parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())    # k * dims rows
    at = cs.at.copy()
    for r in sums:
        at[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return Centroids(at, cs)


def start_vectors(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``; null ids last, ties by vector."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.orderBy(mark.asc_nulls_last(), "v").select("v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id, v, cluster, distance, cluster_inertia, inertia, centroid, n_measured`` for every row of ``vectors``.

    ``vectors`` is ``(vec_id, v array<long>)`` as :func:`quantise` makes it.  ``rounds`` times every vector goes
    to its nearest centroid (squared Euclidean distance, ties to the smaller number) and every centroid with
    vectors moves to the exact floor of their mean; then vectors are assigned once more.  ``n_measured`` counts
    the centroid distances that a vector has cost over all passes.  Rows that repeat an id or a vector each
    count; a null id takes part and starts a centroid only where others don't suffice.  With fewer than ``k``
    vectors there are as many centroids; an empty table gives an empty table.  Other columns of ``vectors`` are
    not carried.  Inertias beyond 64 bits are given as the largest long.
    """
    spark = vectors.sparkSession
    if k < 1 or k > MAX_CENTROIDS or k * dims > MAX_CELLS:
        raise ValueError(f"between 1 and {MAX_CENTROIDS} centroids, {MAX_CELLS} numbers in all")
    prepare_python(spark)
    out = "vec_id long, v array<long>, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, n_measured int"
    vectors = vectors.select("vec_id", "v")
    chosen = start_vectors(vectors, k, seed)
    if not chosen:
        return spark.createDataFrame([], out)
    cs, state = Centroids(np.array(chosen, np.int64)), vectors
    for r in range(rounds + 1):
        before, state = state, materialize(state.mapInArrow(partial(_assign_batches, cs=cs, last=r == rounds), _STATE), "shallot")
        if r:
            discard(before)
        if r < rounds:
            cs = _moved(state, cs)
    top = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    per = {row["cluster"]: int(row["s"]) for row in state.groupBy("cluster")
           .agg(F.least(F.sum(F.col("distance").cast("decimal(38,0)")), top).alias("s")).collect()}          # k rows
    whole = min(sum(per.values()), 2 ** 63 - 1)
    known = spark.createDataFrame([(c, s, whole, cs.at[c].tolist()) for c, s in sorted(per.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (state.join(F.broadcast(known), "cluster")                  # as many rows as centroids
            .select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "n_measured"))


def centroid_digest(col: str = "centroid"):
    """Lowercase hex sha256 of a centroid's components, as decimal integers joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(col).cast("array<string>")), 256)
