"""Fitted-model artifacts: train once, persist, reload.

Models, thresholds and metrics are written as runs of an artifact store under the shared checkpoint
directory (``spark.checkpoint.dir``), keyed by the input files, the code and the
training parameters, and re-loaded by later plans — the train → persist →
serve boundary of the original application, without retraining per report.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import ensemble as EN
from ..operators import scoring as SC
from ..operators import train as TR
from ..operators.features import model_matrix
from ..session import ensure_checkpoint_dir
from ..sources.store import ArtifactStore
from . import tables as TB

_MEM: dict = {}


_CODE = ("operators/train.py", "operators/boost.py", "operators/resample.py", "operators/split.py", "operators/evaluate.py")


def _key(spark: SparkSession, sf_dir: str, params: dict) -> str:
    """Names a model by its input files, the code that fits it, and its parameters."""
    data = TB.fingerprint(spark, sf_dir, code=(*TB._CODE, *_CODE))
    text = json.dumps([data, sorted(params.items()), S.FEATURES], default=str)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def models(spark: SparkSession, sf_dir: str, params: dict = S.STORED_PARAMS) -> dict:
    """GBT + logistic models and their validation thresholds for ``sf_dir``, from the newest published run."""
    k = _key(spark, sf_dir, params)
    if k in _MEM and _MEM[k]["spark"] is spark:
        return _MEM[k]
    store = ArtifactStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-artifacts/{k}")
    run = store.latest()
    if run is None:
        features = TB.feature_store(spark, sf_dir)
        run = TR.train_job(features, store, params, cuts=TB.split_cuts(spark, sf_dir))["published"]
    train = split_matrix(spark, sf_dir).where(F.col("split") == "train")
    thresholds = {r["model"]: r["threshold"] for r in spark.read.json(run.path("thresholds")).collect()}
    _MEM[k] = {"spark": spark, "run": run, "gbt": EN.Ensemble(EN.read_trees(spark, run.path("gbt")), train),
               "lr": PipelineModel.load(run.path("lr")), "thresholds": thresholds,
               "metrics": spark.read.json(run.path("metrics"))}
    return _MEM[k]


def ledger(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the search ledger for these input files and this code."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-ledger/{_key(spark, sf_dir, {})}"


def split_matrix(spark: SparkSession, sf_dir: str):
    return TB.with_split(spark, sf_dir, model_matrix(TB.feature_store(spark, sf_dir)))


def scored_split(spark: SparkSession, sf_dir: str, model: str, split: str = "test"):
    """Rows of one split scored by a persisted model, with bands at its tuned threshold."""
    a = models(spark, sf_dir)
    m = split_matrix(spark, sf_dir).where(F.col("split") == split)
    return SC.add_bands(TR.predict(a[model], m), a["thresholds"][model])
