"""Exact path-dependent tree attributions for an MLlib GBT model (EX1).

For a leaf L with value v, distinct path features F and, per feature j,
``z_j`` = product of child/parent covers over the splits on j along the path
and ``o_j(x)`` = 1 if x satisfies all of those splits, the path-dependent
conditional expectation is a sum of leaf games
``v_L(S) = v · Π_{j∈S} o_j · Π_{j∈F∖S} z_j``.  With m path features, a game's
Shapley values are

    φ_i(o) = v · (o_i − z_i) · Σ_s  s!(m−s−1)!/m! · [t^s] Π_{j≠i} (z_j + o_j·t)

Scoring is a ``mapInPandas`` pass: per Arrow batch, for every leaf, the products
before and after each feature are built once and combined (numpy, vectorised over
rows), O(m³) for any depth.  Covers are plain row counts, whatever weights the model was
fitted with.  The broadcast leaves are bounded by the model, never by the data.
Attributions are in log-odds (Spark's P = σ(2·margin)); base + Σφ = log-odds.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


@dataclass
class Leaf:
    features: np.ndarray     # distinct path features (m,)
    lo: np.ndarray           # o_j = lo_j < x_j <= hi_j
    hi: np.ndarray
    share: np.ndarray        # z_j, the covers' product over the splits on j
    value: float             # log-odds


def leaf_contributions(value: float, z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Shapley values (rows, m) of one leaf game for the 0/1 patterns ``o`` (rows, m)."""
    n, m = o.shape
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])

    def times(poly: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros((n, poly.shape[1] + 1))
        out[:, :-1] = poly * z[j]
        out[:, 1:] += poly * o[:, j:j + 1]
        return out

    before, after = [np.ones((n, 1))], [np.ones((n, 1))]
    for j in range(m - 1):
        before.append(times(before[-1], j))
        after.append(times(after[-1], m - 1 - j))
    phi = np.empty((n, m))
    for i in range(m):
        a, b = before[i], after[m - 1 - i]
        w = weight[np.add.outer(np.arange(a.shape[1]), np.arange(b.shape[1]))]
        phi[:, i] = value * (o[:, i] - z[i]) * np.einsum("na,ab,nb->n", a, w, b)
    return phi


def _patterns(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Which of the leaf's features each row satisfies, as bits from the first feature on."""
    code = np.zeros(len(x), np.int64)
    for j, (f, low, high) in enumerate(zip(leaf.features, leaf.lo, leaf.hi)):
        code |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << j
    return code


def attributions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions (rows, features) of all leaves."""
    x, phi = np.asfortranarray(x), np.zeros(x.shape, order="F")
    for leaf in leaves:
        m, code = len(leaf.features), _patterns(leaf, x)
        if 1 << m <= max(64, len(x)):
            pattern = np.arange(1 << m)                               # few patterns, whatever the rows
        else:
            pattern, code = np.unique(code, return_inverse=True)
        o = (pattern[:, None] >> np.arange(m) & 1).astype(float)
        values = leaf_contributions(leaf.value, leaf.share, o)
        for j, f in enumerate(leaf.features):
            phi[:, f] += values[:, j][code]
    return phi


def extract_leaves(gbt_model, spark, scale: float = 2.0) -> tuple[list[Leaf], float]:
    """Leaves and base value (log-odds) of a fitted ``GBTClassificationModel``.

    The model is written to the shared checkpoint directory and its node table
    read back with Spark; the node table is bounded by the model size.
    """
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeshap-{uuid.uuid4().hex}"
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.rawCount").alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).collect()
    weights = list(gbt_model.treeWeights)
    trees: dict[int, dict[int, object]] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves, base = [], 0.0
    for tid, t in trees.items():
        tw = scale * weights[tid]
        stack = [(0, {})]          # node id, {feature: [lo, hi, z]}
        while stack:
            nid, path = stack.pop()
            n = t[nid]
            if n["leftChild"] < 0:
                feats = sorted(path)
                z = np.array([path[f][2] for f in feats], dtype=float)
                v = tw * n["prediction"]
                base += v * float(np.prod(z)) if len(z) else v
                if feats:
                    leaves.append(Leaf(np.array(feats), np.array([path[f][0] for f in feats]),
                                       np.array([path[f][1] for f in feats]), z, v))
                continue
            f, thr, cover = n["featureIndex"], n["threshold"], n["cover"]
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                lo, hi, z = path.get(f, [-np.inf, np.inf, 1.0])
                ratio = (t[child]["cover"] / cover) if cover > 0 else 0.0
                new = dict(path)
                new[f] = [lo, min(hi, thr), z * ratio] if left else [max(lo, thr), hi, z * ratio]
                stack.append((child, new))
    return leaves, base


def _attribute_fn(leaves: list[Leaf], features: list[str], key: str):
    def fn(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            phi = attributions(leaves, x)
            n, m = x.shape
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), m),
                "feature": np.tile(np.array(features, dtype=object), n),
                "feature_index": np.tile(np.arange(m, dtype=np.int32), n),
                "feature_value": x.ravel(),
                "shap_value": phi.ravel(),
            })
    return fn


def tree_attribution(model, matrix: DataFrame, key: str = "loyalty_number",
                     features: list[str] = S.FEATURES) -> tuple[DataFrame, DataFrame]:
    """(long attribution table, one-row base value) for a fitted GBT pipeline or model."""
    from ..session import ship_package
    gbt = model.stages[-1] if hasattr(model, "stages") else model
    spark = matrix.sparkSession
    ship_package(spark)
    leaves, base = extract_leaves(gbt, spark)
    sc = spark.sparkContext
    bc = sc.broadcast(leaves)           # bounded by the model

    def run(batches):
        yield from _attribute_fn(bc.value, features, key)(batches)

    schema = f"{key} long, feature string, feature_index int, feature_value double, shap_value double"
    values = matrix.select(key, *[F.col(f).cast("double") for f in features]).mapInPandas(run, schema)
    base_df = spark.createDataFrame([(float(base),)], "base_value double")
    return values, base_df
