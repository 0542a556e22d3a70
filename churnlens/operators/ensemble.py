"""A tree ensemble as data: leaves as rows, scores and attributions from them (EX1, SC1–SC3).

A tree is nested tuples ``(feature, threshold, left, right)`` down to leaf values in log-odds; a row
goes left where ``feature <= threshold``.  Its relational form has a row per leaf and feature on the leaf's path:
``(tree, leaf, feature, low, high, share, value, row_count)``, a leaf holding the rows with ``low < x <= high`` for
each of its features.  ``row_count`` counts the background rows in the leaf and ``share`` is the product of child
over parent counts of the splits on that feature, so the table with a background is all that scoring and exact
path-dependent attributions need; the same rows run in the engine and in SQL.

Scores are one native expression per row, and the counts of all leaves one aggregate over the background;
an ensemble of more than ``NATIVE_LEAVES`` leaves, too long for generated code, goes through the same steps in Arrow batches.
Attributions are one Arrow pass that adds an ``array<double>`` to each row; nothing is exploded before it
is reduced: the importance of 31 features is one aggregate of 31 columns.  The model bounds what is
collected or sent to tasks, never the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import title_case
from . import treeshap as TS
from .scoring import PROBABILITY
from .segments import attach_scalar


#: Leaves of an ensemble that is scored by a native expression.
NATIVE_LEAVES = 128
#: A node as a row: its path of L and R from the root, the split, or the value of a leaf.
NODES = "tree int, node string, feature string, threshold double, value double"


@dataclass
class LeafRow:
    """One leaf: its path's bounds per feature, and for each feature the (child, parent) nodes of its splits."""
    tree: int
    leaf: int
    value: float
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    splits: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    nodes: list[str] = field(default_factory=list)                    # from the root to the leaf


def leaves_of(trees: list) -> list[LeafRow]:
    """The leaves of every tree, numbered from the left; a node is named by its path of L and R."""
    out = []
    for t, root in enumerate(trees):
        found: list[LeafRow] = []

        def walk(node, name, bounds, splits, nodes):
            if not isinstance(node, tuple):
                found.append(LeafRow(t, len(found), float(node), bounds, splits, nodes))   # noqa: B023
                return
            f, cut, left, right = node
            low, high = bounds.get(f, (-np.inf, np.inf))
            for side, child, own in (("L", left, (low, min(high, cut))), ("R", right, (max(low, cut), high))):
                walk(child, name + side, {**bounds, f: own},
                     {**splits, f: [*splits.get(f, []), (name + side, name)]}, [*nodes, name + side])

        walk(root, "", {}, {}, [""])
        out += found
    return out


def _inside(leaf: LeafRow) -> Column:
    cond = F.lit(True)
    for f, (low, high) in leaf.bounds.items():
        if np.isfinite(low):
            cond = cond & (F.col(f) > F.lit(float(low)))
        if np.isfinite(high):
            cond = cond & (F.col(f) <= F.lit(float(high)))
    return cond


def margin(trees: list) -> Column:
    """Log-odds of a row of guarded model inputs: the trees' values, added in their order."""
    def value(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, cut, left, right = node
        return F.when(F.col(f) <= F.lit(float(cut)), value(left)).otherwise(value(right))

    total = F.lit(0.0)
    for tree in trees:
        total = total + value(tree)
    return total


def probability(trees: list, digits: int = 6) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(trees))), digits)


def _flat(node, features: list[str]) -> tuple[list[np.ndarray], int]:
    """A tree as arrays (feature or -1, threshold, left, right, value, leaf number) and its depth."""
    rows: list[list] = []
    leaves = 0

    def walk(node, depth):
        nonlocal leaves
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, 0.0, -1])
        if not isinstance(node, tuple):
            rows[at][4:] = [float(node), leaves]
            leaves += 1
            return at, depth
        rows[at][:2] = [features.index(node[0]), float(node[1])]
        rows[at][2], d1 = walk(node[2], depth + 1)
        rows[at][3], d2 = walk(node[3], depth + 1)
        return at, max(d1, d2)

    depth = walk(node, 0)[1]
    return [np.array(c) for c in zip(*rows)], depth


def _ends(tree: tuple[list[np.ndarray], int], x: np.ndarray) -> np.ndarray:
    """The leaf node of every row of ``x``."""
    (feature, cut, left, right, _, _), depth = tree
    node, at = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, np.where(x[at, np.maximum(f, 0)] <= cut[node], left[node], right[node]), node)
    return node


def score(matrix: DataFrame, trees: list, features: list[str] = S.FEATURES) -> DataFrame:
    """SC1 — ``churn_probability`` from the ensemble, rounded to 6 digits."""
    if len(leaves_of(trees)) <= NATIVE_LEAVES:
        return matrix.withColumn(PROBABILITY, probability(trees))
    from pyspark.sql import types as T

    from ..session import ship_package
    ship_package(matrix.sparkSession)
    bc = matrix.sparkSession.sparkContext.broadcast([_flat(t, features) for t in trees])      # bounded by the model

    def run(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for tree in bc.value:
                total += tree[0][4][_ends(tree, x)]
            yield pdf.assign(**{"_margin": total})

    margins = matrix.mapInPandas(run, T.StructType([*matrix.schema.fields, T.StructField("_margin", T.DoubleType())]))
    return margins.withColumn(PROBABILITY, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin"))), 6)).drop("_margin")


def row_counts(background: DataFrame, trees: list, features: list[str] = S.FEATURES) -> list[int]:
    """Background rows in every leaf, in the order of :func:`leaves_of`: one aggregate, as wide as the model has leaves."""
    leaves = leaves_of(trees)
    if len(leaves) <= NATIVE_LEAVES:
        return [int(n) for n in background.agg(*[F.count_if(_inside(x)).alias(f"n{i}") for i, x in enumerate(leaves)]).first()]
    from ..session import ship_package
    ship_package(background.sparkSession)
    flat = [_flat(t, features) for t in trees]
    sizes = [int(t[0][5].max()) + 1 for t in flat]
    first = np.concatenate([[0], np.cumsum(sizes)])

    def run(batches):
        import pandas as pd
        counts = np.zeros(first[-1], np.int64)
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            for i, tree in enumerate(flat):
                counts[first[i]:first[i + 1]] += np.bincount(tree[0][5][_ends(tree, x)], minlength=sizes[i])
        yield pd.DataFrame({"leaf": np.arange(len(counts)), "n": counts})

    parts = background.select(*[F.col(f).cast("double") for f in features]).mapInPandas(run, "leaf long, n long")
    found = {r["leaf"]: r["n"] for r in parts.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(i, 0)) for i in range(first[-1])]


def node_rows(trees: list) -> list[tuple]:
    """The trees as node rows (``NODES``)."""
    out = []

    def walk(t, node, name):
        if isinstance(node, tuple):
            out.append((t, name, node[0], float(node[1]), None))
            walk(t, node[2], name + "L")
            walk(t, node[3], name + "R")
        else:
            out.append((t, name, None, None, float(node)))

    for t, tree in enumerate(trees):
        walk(t, tree, "")
    return out


def write_trees(spark: SparkSession, trees: list, path: str) -> None:
    """IO7 — the model as a table of its nodes."""
    spark.createDataFrame(node_rows(trees), NODES).coalesce(1).write.mode("overwrite").parquet(path)


def read_trees(spark: SparkSession, path: str) -> list:
    """IO7 — the trees of a node table."""
    found = {(r["tree"], r["node"]): r for r in spark.read.schema(NODES).parquet(path).collect()}      # as long as the model

    def walk(t, name):
        r = found[t, name]
        return r["value"] if r["feature"] is None else (r["feature"], r["threshold"], walk(t, name + "L"), walk(t, name + "R"))

    return [walk(t, "") for t in sorted({t for t, _ in found})]


def shares(leaves: list[LeafRow], counts: list[int]) -> list[dict[str, float]]:
    """For each leaf and feature the product of child over parent counts of its splits (0 where none came)."""
    at: dict[tuple[int, str], int] = {}
    for leaf, n in zip(leaves, counts):
        for node in leaf.nodes:
            at[leaf.tree, node] = at.get((leaf.tree, node), 0) + n
    out = []
    for leaf in leaves:
        own = {}
        for f, pairs in leaf.splits.items():
            z = 1.0
            for child, parent in pairs:
                z *= at[leaf.tree, child] / at[leaf.tree, parent] if at[leaf.tree, parent] else 0.0
            own[f] = z
        out.append(own)
    return out


def leaf_table(background: DataFrame, trees: list, features: list[str] = S.FEATURES) -> DataFrame:
    """The relational form; infinite bounds are null.  A tree of one leaf has no row."""
    leaves = leaves_of(trees)
    counts = row_counts(background, trees, features)
    rows = [(x.tree, x.leaf, f, features.index(f), None if np.isinf(a) else float(a), None if np.isinf(b) else float(b), z[f], x.value, n)
            for x, z, n in zip(leaves, shares(leaves, counts), counts) for f, (a, b) in x.bounds.items()]
    return background.sparkSession.createDataFrame(
        rows, "tree int, leaf int, feature string, feature_index int, low double, high double, share double, value double, row_count long")


def games(background: DataFrame, trees: list, features: list[str] = S.FEATURES) -> tuple[list[TS.Leaf], float]:
    """The leaves as attribution games, and the base value: the background's expected log-odds by paths."""
    leaves = leaves_of(trees)
    out, base = [], 0.0
    for x, z in zip(leaves, shares(leaves, row_counts(background, trees, features))):
        names = sorted(x.bounds, key=features.index)
        own = np.array([z[f] for f in names])
        base += x.value * float(np.prod(own))
        if names:
            out.append(TS.Leaf(np.array([features.index(f) for f in names]), np.array([x.bounds[f][0] for f in names]),
                               np.array([x.bounds[f][1] for f in names]), own, x.value))
    return out, base


def attribution_arrays(leaves: list[TS.Leaf], matrix: DataFrame, features: list[str] = S.FEATURES) -> DataFrame:
    """``matrix`` plus ``phi``, the row's attributions in the features' order, rounded to 9 digits.

    One Arrow pass, no shuffle, and no row more than came in.
    """
    from pyspark.sql import types as T

    from ..session import ship_package
    ship_package(matrix.sparkSession)
    bc = matrix.sparkSession.sparkContext.broadcast(leaves)              # bounded by the model

    def run(batches):
        for pdf in batches:
            phi = TS.attributions(bc.value, pdf[features].to_numpy(dtype=float)) if len(pdf) else np.zeros((0, len(features)))
            yield pdf.assign(phi=list(np.round(phi, 9) + 0.0))

    schema = T.StructType([*matrix.schema.fields, T.StructField("phi", T.ArrayType(T.DoubleType()))])
    return matrix.mapInPandas(run, schema)


def long_attributions(rows: DataFrame, key: str = "loyalty_number", features: list[str] = S.FEATURES) -> DataFrame:
    """EX1 — the array rows as ``(key, feature, feature_index, feature_value, shap_value)``."""
    pairs = ", ".join(f"named_struct('feature', '{f}', 'feature_index', {i}, 'feature_value', CAST(`{f}` AS DOUBLE), 'shap_value', phi[{i}])"
                      for i, f in enumerate(features))
    return rows.selectExpr(f"`{key}`", f"inline(array({pairs}))")


def importance(rows: DataFrame, features: list[str] = S.FEATURES) -> DataFrame:
    """AG21 / EX5 — mean |φ| per feature and rank: one aggregate row of as many columns as features."""
    means = rows.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f) for i, f in enumerate(features)])
    order = ", ".join(f"named_struct('o', -coalesce(`{f}`, 0D), 'feature_index', {i}, 'feature', '{f}', 'importance', `{f}`)"
                      for i, f in enumerate(features))
    out = means.selectExpr(f"posexplode(sort_array(array({order}))) AS (pos, r)")
    return out.select("r.feature", "r.feature_index", title_case("r.feature").alias("display_name"), "r.importance",
                      (F.col("pos") + 1).alias("rank"))


def top_factor(features: list[str] = S.FEATURES) -> Column:
    """SC2 — the feature with the largest |φ|; the first of equal ones."""
    size = F.transform("phi", lambda x: F.abs(x))
    return F.get(F.array(*[F.lit(f) for f in features]), (F.array_position(size, F.array_max(size)) - 1).cast("int"))


def dependence(rows: DataFrame, ranks: DataFrame, top: int = 3, bins: int = 20, features: list[str] = S.FEATURES) -> DataFrame:
    """EX7 — equal-width bins of the top features' values with their mean attribution."""
    from .explain import dependence_data
    first = ranks.where(F.col("rank") <= top).agg(F.collect_list(F.struct("feature", "feature_index")).alias("_first"))
    values = F.array(*[F.col(f).cast("double") for f in features])
    picked = (attach_scalar(rows.select(values.alias("_x"), "phi"), first)        # as many as ``top``
              .select("_x", "phi", F.explode("_first").alias("_f"))
              .select("_f.feature", F.get("_x", F.col("_f.feature_index")).alias("feature_value"),
                      F.get("phi", F.col("_f.feature_index")).alias("shap_value")))
    return dependence_data(picked, ranks, top, bins)


class Ensemble:
    """Trees with a background: what scoring, explaining and the stream take in place of a fitted pipeline."""

    def __init__(self, trees: list, background: DataFrame):
        self.trees = trees
        self.leaves, self.base = games(background, trees)

    def predict(self, matrix: DataFrame) -> DataFrame:
        return score(matrix, self.trees)

    def with_top_factor(self, scored: DataFrame) -> DataFrame:
        return attribution_arrays(self.leaves, scored).withColumn("top_risk_factor", top_factor()).drop("phi")


class Fitted:
    """A fitted booster in the same role; its leaves are read once."""

    def __init__(self, model, spark: SparkSession):
        self.model = model
        self.leaves, self.base = TS.extract_leaves(model.stages[-1] if hasattr(model, "stages") else model, spark)

    def predict(self, matrix: DataFrame) -> DataFrame:
        from .train import predict
        return predict(self.model, matrix)

    def with_top_factor(self, scored: DataFrame) -> DataFrame:
        return attribution_arrays(self.leaves, scored).withColumn("top_risk_factor", top_factor()).drop("phi")
