"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot.  A few numbers summarise each group of data: its size, its
radius and the smallest distances to its pivot.  With inner products, a vector at distance e from pivot p
scores between q.p - |q|e and q.p + |q|e; so the summaries give every query a score that k other vectors
reach for certain, and every group of queries a distance below which a group's vectors can't reach it.
Only vectors beyond that distance are replicated to the query group, in bounded blocks, and solved there;
each block's best k are merged.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare_python

#: Pivots, and the rows of a block of data and of queries.
PIVOTS, DATA_BLOCK, QUERY_BLOCK = 32, 8192, 1024


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component; invalid vectors and null ids left out."""
    x = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(True)))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v")))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy()[col.offsets[0].as_py():col.offsets[-1].as_py()]
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _gap(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``m`` from the pivots."""
    return np.stack([np.sqrt(((m - q) ** 2).sum(axis=1)) for q in p], axis=1)


def _cell_batches(batches, pivots: np.ndarray):
    for b in batches:
        m = _matrix(b.column(1), pivots.shape[1])
        gap = _gap(m.astype(np.float64), pivots)
        cell = gap.argmin(axis=1) if len(m) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(gap[np.arange(len(m)), cell], pa.float64()), b.column(2)],
            names=["vec_id", "v", "cell", "gap", "n"])


def _need_batches(batches, pivots: np.ndarray, near: list[list[tuple[float, int]]], k: int):
    """For each query group and data cell the distance that a vector must have to matter to a query.

    ``near``: for each cell the smallest distances, each of another id, and those ids.
    """
    least = np.full((len(pivots), len(pivots)), np.inf)
    seen = np.zeros(len(pivots), bool)
    owner = np.concatenate([np.full(len(e), j) for j, e in enumerate(near)]).astype(int)
    gaps, ids = (np.array([e[i] for c in near for e in c], t) for i, t in enumerate((np.float64, np.int64)))
    for b in batches:
        q = _matrix(b.column(1), pivots.shape[1]).astype(np.float64)
        if not len(q):
            continue
        cell, norm, dot = b.column(2).to_numpy(), np.sqrt((q ** 2).sum(axis=1)), q @ pivots.T
        sure = dot[:, owner] - norm[:, None] * gaps
        sure[b.column(0).to_numpy()[:, None] == ids] = -np.inf               # a query never meets its own id
        # the k-th; -inf: fewer vectors than that
        floor = np.sort(sure, axis=1)[:, -k] if sure.shape[1] >= k else np.full(len(q), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = (floor[:, None] - dot) / norm[:, None]
        need = np.where(np.isfinite(need), need - 1e-6 * (1 + np.abs(need)), -np.inf)
        np.minimum.at(least, cell, need)
        seen[np.unique(cell)] = True
    g, c = np.meshgrid(np.flatnonzero(seen), np.arange(len(pivots)), indexing="ij")
    yield pa.RecordBatch.from_arrays([pa.array(g.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()),
                                      pa.array(least[g.ravel(), c.ravel()])], names=["grp", "cell", "need"])


def _solve(key, queries: pa.Table, data: pa.Table, k: int, width: int) -> pa.Table:
    """The best k of one block of data for one block of queries; all that tie with the k-th are kept."""
    out_q, out_v, out_s, out_n = [], [], [], []
    if len(queries) and len(data):
        q, y = (_matrix(t.column("v").combine_chunks(), width) for t in (queries, data))
        q_id, y_id = (t.column("vec_id").to_numpy() for t in (queries, data))
        copies = data.column("n").to_numpy()
        # doubles are exact below 2**53 and multiply much faster
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(y).max(initial=0)) * width < 2 ** 53
        for a in range(0, len(q), 128):
            part = q[a:a + 128]
            s = (part.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if exact else part @ y.T
            own = q_id[a:a + 128, None] == y_id[None, :]
            for i in range(len(part)):
                at = np.flatnonzero(~own[i])
                row = s[i, at]
                if len(row) > k:
                    best = np.partition(row, len(row) - k)[len(row) - k]
                    at, row = at[row >= best], row[row >= best]
                    order = np.lexsort((y_id[at], -row))[:k]
                    at, row = at[order], row[order]
                out_q.append(np.full(len(at), q_id[a + i]))
                out_v.append(y_id[at])
                out_s.append(row)
                out_n.append(copies[at])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s), "n": cat(out_n)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products among ``vectors``.

    Both tables are ``(vec_id, v array<long>)``; a query never meets a row of its own id.  Ties go to the
    smaller id.  Vectors shorter than the longest count as filled up with zeros; a query with fewer than k
    others gets them all.  Every row of ``vectors`` is a candidate: rows that repeat an id and vector are solved once
    and take as many ranks as they are.  Queries that repeat an id and vector count once.  Scores beyond 64
    bits wrap around.
    """
    spark = vectors.sparkSession
    prepare_python(spark)
    vectors = materialize(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n")), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    chosen = vectors.groupBy("v").agg(F.min("vec_id").alias("i")).orderBy(F.xxhash64("i"), "i").limit(PIVOTS).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, :len(r["v"])] = r["v"]
    celled = partial(_cell_batches, pivots=pivots)
    kind = "vec_id long, v array<long>, cell int, gap double, n long"
    data = materialize(vectors.mapInArrow(celled, kind), "cells")
    asked = materialize(queries.select("vec_id", "v").distinct().withColumn("n", F.lit(1).cast("long")).mapInArrow(celled, kind), "asked")
    low = Window.partitionBy("cell").orderBy("gap", "vec_id")
    # the smallest distances of k+1 ids in each cell, so k are left without the query's own, however many vectors
    # share an id: first within salted parts, so a large cell is not one task
    parts = (data.groupBy("cell", "vec_id").agg(F.min("gap").alias("gap"))
             .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
             .withColumn("r", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("gap", "vec_id"))).where(f"r <= {k + 1}"))
    near: list[list[tuple[float, int]]] = [[] for _ in chosen]
    for r in parts.withColumn("r", F.row_number().over(low)).where(f"r <= {k + 1}").select("cell", "gap", "vec_id").collect():
        near[r["cell"]].append((r["gap"], r["vec_id"]))
    need = (asked.mapInArrow(partial(_need_batches, pivots=pivots, near=near, k=k), "grp int, cell int, need double")
            .groupBy("grp", "cell").agg(F.min("need").alias("need")))
    need = materialize(need, "need")                                     # at most PIVOTS x PIVOTS rows
    sent = data.join(F.broadcast(need), "cell").where("gap >= need")
    size = sent.groupBy("grp").agg(F.count("*").alias("n_data"))
    asks = asked.groupBy(F.col("cell").alias("grp")).agg(F.count("*").alias("n_query"))
    blocks = materialize(size.join(asks, "grp").select(
        "grp", F.ceil(F.col("n_data") / DATA_BLOCK).cast("int").alias("d_blocks"),
        F.ceil(F.col("n_query") / QUERY_BLOCK).cast("int").alias("q_blocks")), "blocks")   # at most PIVOTS rows
    left = (asked.withColumnRenamed("cell", "grp").join(F.broadcast(blocks), "grp")
            .select("grp", F.pmod(F.xxhash64("vec_id", "v"), F.col("q_blocks")).alias("qb"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("d_blocks").cast("long") - 1)).alias("db"), "vec_id", "v"))
    right = (sent.join(F.broadcast(blocks), "grp")
             .select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks").cast("long") - 1)).alias("qb"),
                     F.pmod(F.xxhash64("vec_id", "v"), F.col("d_blocks")).alias("db"), "vec_id", "v", "n"))
    keys = ["grp", "qb", "db"]
    solved = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
              .applyInArrow(partial(_solve, k=k, width=width), "query_id long, vec_id long, score long, n long"))
    solved = solved.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (solved.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")
            .select("query_id", "rank", "vec_id", "score"))
