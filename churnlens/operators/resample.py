"""Minority oversampling by interpolation (SMOTE-style) on training rows.

Steps, all distributed:

1. **Exact k nearest minority neighbours by a pruned join.**  Rows with equal features are one point.  Points
   go to the cell of their nearest pivot; a cell knows its radius, the largest distance from its pivot.  Every
   point is first solved against its own cell, which bounds the distance of its k-th neighbour from above.  By the triangle
   inequality a cell whose distance from the point, less its radius, exceeds that bound holds no neighbour; only the
   other cells get a copy of the point, and return what lies within the bound.  Which pairs may count is told by a matrix
   product with room for its rounding; these alone are measured.  A cell is met in blocks of at most ``block_rows`` points, so no
   task sees more than two blocks; the k best of all blocks are the k nearest, ties by key.
2. **Exact number of children per row.**  Rows are ranked by a seeded md5 (distributed running totals); row r gets
   ``floor((r+1)·n/m) − floor(r·n/m)`` children, which sums to exactly n.
3. **Interpolation.**  Each child picks one of its parent's neighbours and a gap u ∈ [0, 1) from seeded md5
   digits: ``x + u·(neighbour − x)``.  All picks are portable to SQL.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .ranking import running_totals
from .segments import attach_scalar

#: Pivots at most: their table travels with every task.
MAX_PIVOTS = 1024
_DIGITS = 13                                 # hex digits of an md5 taken as a number: 52 bits
_SLACK = 1e-9


def md5_number(*parts) -> Column:
    """The first 52 bits of the md5 of the parts' texts, joined by ``-``."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, pair by pair, by differences."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 14):
        out[i:i + (1 << 14)] = np.sqrt(((a[i:i + (1 << 14)] - b[i:i + (1 << 14)]) ** 2).sum(axis=1))
    return out


def _squares(a: np.ndarray, b: np.ndarray):
    """For some rows of ``a`` at a time: their number, squared distances of all rows of ``b`` by a product, and how far these may be off."""
    step, middle = max(1, (1 << 20) // max(1, len(b))), b.mean(axis=0)
    b = b - middle
    own = (b * b).sum(axis=1)
    for i in range(0, len(a), step):
        part = a[i:i + step] - middle
        size = (part * part).sum(axis=1)[:, None] + own
        yield np.arange(i, i + len(part)), size - 2 * (part @ b.T), size * _SLACK


def _cell_batches(batches, pivots: np.ndarray):
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(1))
            cell = np.concatenate([square.argmin(axis=1) for _, square, _ in _squares(x, pivots)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(_distance(x, pivots[cell]))],
                                             names=["point", "x", "cell", "gap"])


def _visit_batches(batches, pivots: np.ndarray, cells: dict[int, tuple[float, int]]):
    """A copy of each point for every block of each cell that may hold one of its neighbours, but its own cell."""
    number = np.array(sorted(cells), np.int64)
    radius, blocks = (np.array([cells[c][i] for c in number.tolist()]) for i in (0, 1))
    for b in batches:
        if not b.num_rows:
            continue
        reach = b.column(3).fill_null(np.inf).to_numpy(zero_copy_only=False)
        home = b.column(2).to_numpy()
        found = []
        for rows, square, off in _squares(_matrix(b.column(1)), pivots[number]):
            gap = np.sqrt(np.maximum(square - off, 0))
            beyond = (gap - radius) * (1 - _SLACK) > reach[rows, None] * (1 + _SLACK)
            row, at = np.nonzero(~beyond & (home[rows, None] != number))
            found.append((rows[row], at))
        row, at = (np.concatenate(part) for part in zip(*found))
        times = blocks[at].astype(np.int64)
        row, cell = np.repeat(row, times), np.repeat(number[at], times)
        block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell, pa.int32()),
                                          pa.array(block, pa.int32()), b.column(3).take(pa.array(row))], names=["point", "x", "cell", "block", "reach"])


def _solve(key, asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The k nearest points of one block for each asking point, ties by number; a point is not its own neighbour.

    Points beyond an asking point's reach are left out.  Products tell which pairs may count; these alone are measured.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(asked) and len(held):
        q, x = _matrix(asked.column("q_x").combine_chunks()), _matrix(held.column("x").combine_chunks())
        q_id, x_id = asked.column("q_point").to_numpy(), held.column("point").to_numpy()
        reach = asked.column("q_reach").fill_null(np.inf).to_numpy()
        for rows, square, off in _squares(q, x):
            least = square - off
            may = ~(least > (reach[rows, None] * (1 + _SLACK)) ** 2)
            many = np.flatnonzero(may.sum(axis=1) > k + 1)
            if len(many) and len(x) > k + 1:                            # the point itself may be one of k + 1
                most = np.partition(square[many] + off[many], k, axis=1)[:, k]
                may[many] &= ~(least[many] > most[:, None])
            row, at = np.nonzero(may & (q_id[rows, None] != x_id))
            row = rows[row]
            dist = _distance(q[row], x[at])
            near = ~(dist > reach[row])
            row, at, dist = row[near], x_id[at[near]], dist[near]
            order = np.lexsort((at, dist, row))
            row, at, dist = row[order], at[order], dist[order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[:len(row)])
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            out.append((q_id[row[place < k]], at[place < k], dist[place < k]))
    return pa.table(dict(zip(("point", "near", "dist"), (np.concatenate(part) for part in zip(*out)))))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("point").orderBy("dist", "near")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def pivot_cells(points: DataFrame, pivots: int | None = None, seed: int = S.SPLIT_SEED) -> tuple[DataFrame, np.ndarray]:
    """``(point, x)`` with the cell of each point's nearest pivot and the distance, and the pivots."""
    n = points.count()
    m = pivots or min(MAX_PIVOTS, max(1, math.isqrt(n)))
    rows = points.orderBy(md5_number(F.col("point"), seed, "pivot"), "point").limit(m).collect()          # at most MAX_PIVOTS
    at = np.array([r["x"] for r in rows], float)
    return points.mapInArrow(partial(_cell_batches, pivots=at), "point long, x array<double>, cell int, gap double"), at


def nearest_points(points: DataFrame, k: int, block_rows: int = 2048, pivots: int | None = None,
                   seed: int = S.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """``(point, near, dist)`` of the k nearest other points of each point (fewer if there are not so many),
    and the copies ``(point, x, cell, block, reach)`` of points that were sent to other cells."""
    celled, at = pivot_cells(points, pivots, seed)
    celled = celled.checkpoint()
    cells = {r["cell"]: (r["radius"], math.ceil(r["n"] / block_rows))
             for r in celled.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}  # as many as pivots
    count = F.create_map(*[F.lit(v) for c, (_, n) in sorted(cells.items()) for v in (c, n)])[F.col("cell")]
    held = celled.select("point", "x", "cell", F.pmod(md5_number(F.col("point"), seed, "block"), count).cast("int").alias("block")).checkpoint()

    def solve(asked: DataFrame) -> DataFrame:
        """The k nearest per point and block; many askers of one block come in parts of bounded size."""
        where = ["cell", "block"]
        parts = asked.groupBy(*where).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).checkpoint()
        left = (asked.join(parts, where).withColumn("part", F.pmod(md5_number(F.col("point"), seed, "part"), F.col("parts")).cast("int")))
        right = held.join(parts, where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asks = left.select(*[F.col(c).alias(f"q_{c}") for c in ("point", "x", *where, "part", "reach")])
        return (asks.groupBy("q_cell", "q_block", "q_part")
                .cogroup(right.select("point", "x", *where, "part").groupBy(*where, "part"))
                .applyInArrow(partial(_solve, k=k), "point long, near long, dist double"))

    own = celled.select("point", "x", "cell", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.lit(None).cast("double").alias("reach"))
    own_best = _best(solve(own), k).drop("_r").checkpoint()
    bound = own_best.groupBy("point").agg(F.when(F.count("*") == k, F.max("dist")).alias("reach"))
    asking = celled.join(bound, "point", "left").select("point", "x", "cell", "reach")
    sent = asking.mapInArrow(partial(_visit_batches, pivots=at, cells=cells), "point long, x array<double>, cell int, block int, reach double").checkpoint()
    return _best(own_best.unionByName(solve(sent)), k).drop("_r"), sent


def nearest_neighbors(minority: DataFrame, features: list[str] = S.FEATURES, k: int = S.OVERSAMPLE_NEIGHBORS,
                      key: str = "loyalty_number", block_rows: int = 2048, seed: int = S.SPLIT_SEED,
                      pivots: int | None = None) -> DataFrame:
    """(key, neighbors: array<bigint> of the k nearest other rows, nearest first, ties by key)."""
    from ..session import ensure_checkpoint_dir, ship_package
    ship_package(minority.sparkSession)
    ensure_checkpoint_dir(minority.sparkSession)
    rows = minority.select(F.col(key).cast("long").alias("_key"), F.array(*[F.col(f).cast("double") + 0.0 for f in features]).alias("x"))
    # equal rows are one point, known by its first key; only the first k + 1 keys of a point can be neighbours
    w = Window.partitionBy("x").orderBy("_key")
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    points = (ranked.groupBy("x").agg(F.sort_array(F.collect_list("_key")).alias("keys"))
              .select(F.element_at("keys", 1).alias("point"), "x", "keys").checkpoint())
    if points.limit(2).count() < 2 and rows.limit(2).count() < 2:
        raise ValueError("oversampling needs two minority rows or more")
    near, _ = nearest_points(points.select("point", "x"), k, block_rows, pivots, seed)
    others = near.join(points.select(F.col("point").alias("near"), "keys"), "near")
    listed = others.groupBy("point").agg(F.collect_list(F.struct("dist", "keys")).alias("o"))              # at most k
    own = points.join(listed, "point", "left").select(
        "x", F.array_sort(F.concat(
            F.transform("keys", lambda n: F.struct(F.lit(0.0).alias("dist"), n.alias("key"))),
            F.coalesce(F.flatten(F.transform("o", lambda p: F.transform(p["keys"], lambda n: F.struct(p["dist"].alias("dist"), n.alias("key"))))),
                       F.array().cast("array<struct<dist:double,key:bigint>>")))).alias("c"))
    keyed = rows.join(own, "x").select("_key", F.filter("c", lambda s: s["key"] != F.col("_key")).alias("c"))
    return keyed.select(F.col("_key").alias(key), F.transform(F.slice("c", 1, k), lambda s: s["key"]).alias("neighbors"))


def oversample(train: DataFrame, label: str = "churn", features: list[str] = S.FEATURES,
               ratio: float = S.OVERSAMPLE_RATIO, k: int = S.OVERSAMPLE_NEIGHBORS, seed: int = S.SPLIT_SEED,
               key: str = "loyalty_number", block_rows: int = 2048) -> DataFrame:
    """Train rows + synthetic minority rows bringing minority to ``ratio`` × majority.

    Output columns: key, features…, label, ``synthetic`` (0/1), ``parent``,
    ``neighbor``.  Synthetic keys are negative (a seeded md5 of parent and child).
    """
    base = train.select(key, *features, label)
    minority = base.where(F.col(label) == 1)
    counts = base.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    counts = counts.withColumn("n_syn", F.greatest((F.lit(ratio) * F.col("n_neg") - F.col("n_pos")).cast("long"),
                                                  F.lit(0)))
    nbrs = nearest_neighbors(minority, features, k, key, block_rows, seed)

    # Exact children count per parent from a hash rank, equal hashes in the order of their keys.
    h = minority.select(key, md5_number(F.col(key), seed, "rank").alias("_h"))
    ranked = (running_totals(h.withColumn("_one", F.lit(1)), "_h", ["_one"], then=[key])
              .withColumn("_rank", F.col("cum__one") - 1))
    ranked = attach_scalar(ranked, counts.select("n_pos", "n_syn"))
    kids = F.expr("((_rank + 1) * n_syn) div n_pos - (_rank * n_syn) div n_pos")
    children = (ranked.select(key, kids.cast("int").alias("_kids")).where(F.col("_kids") > 0)
                .select(key, F.explode(F.sequence(F.lit(1), F.col("_kids"))).alias("child")))
    children = children.join(nbrs, key)
    pick = F.pmod(md5_number(F.col(key), F.col("child"), seed, "pick"), F.size("neighbors")) + 1
    gap = md5_number(F.col(key), F.col("child"), seed, "gap").cast("double") / F.lit(float(2 ** (4 * _DIGITS)))
    children = children.select(F.col(key).alias("parent"), "child",
                               F.element_at("neighbors", pick.cast("int")).alias("neighbor"), gap.alias("_u"))
    px = minority.select(F.col(key).alias("parent"), *[F.col(f).alias(f"_p_{f}") for f in features])
    nx = minority.select(F.col(key).alias("neighbor"), *[F.col(f).alias(f"_n_{f}") for f in features])
    syn = children.join(px, "parent").join(nx, "neighbor")
    syn_key = -md5_number(F.col("parent"), F.col("child"), seed, "key") - 1
    syn = syn.select(syn_key.alias(key),
                     *[(F.col(f"_p_{f}") + F.col("_u") * (F.col(f"_n_{f}") - F.col(f"_p_{f}"))).alias(f)
                       for f in features],
                     F.lit(1).alias(label), F.lit(1).alias("synthetic"), "parent", "neighbor")
    real = base.select(key, *features, label, F.lit(0).alias("synthetic"),
                       F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("neighbor"))
    return real.unionByName(syn)
