"""Quality selection by importance resampling (Xie et al., 2023).

Two bag-of-hashed-n-grams models, of target text and of all text, give every document a log importance
weight: the sum over its n-grams of the log ratio of the two models.  Adding Gumbel noise and keeping the
top k samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare_python, text_key
from .ranking import global_rank
from .sample import MAX_LABELLED, labelled_sample

BUCKETS = 10_000
CHUNK = 1 << 16


def buckets(text: bytes | None, n: int = BUCKETS):
    """Arrays of the hash buckets of a text's lower-case words and word pairs."""
    ws = (text or b"").lower().split()
    for a in range(0, len(ws), CHUNK):
        part = ws[a:a + CHUNK + 1]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(11)
        own = h[:CHUNK]
        yield np.concatenate([own % np.uint64(n), pair % np.uint64(n)]).astype(np.int64)


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(b.column(b.schema.get_field_index("text")), pa.binary()).to_pylist()


def _count_batches(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in _texts(b):
            for x in buckets(text):
                total += np.bincount(x, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])


def _weigh_batches(batches, ratio: np.ndarray):
    for b in batches:
        w = [float(sum(ratio[x].sum() for x in buckets(t))) for t in _texts(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64())],
                                         names=["doc_id", "text_key", "log_weight"])


def model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets, with one added to each count; one row a bucket reaches the driver."""
    prepare_python(docs.sparkSession)
    rows = (docs.select("text").mapInArrow(_count_batches, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    n = np.ones(BUCKETS)
    for r in rows:
        n[r["bucket"]] += r["n"]
    return np.log(n / n.sum())


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``(doc_id, text_key, log_weight)`` of every row; a null or empty text weighs 0."""
    ratio = model(target) - model(docs)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
            .mapInArrow(partial(_weigh_batches, ratio=ratio), "doc_id long, text_key long, log_weight double"))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 7,
             limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text_key, log_weight, gumbel_score, rank, selected`` for every row of ``docs``.

    Target: labelled documents of quality 1 (a bounded sample).  ``keep``: share of rows to select; by
    default the share of quality 1 among all labels (1 without labels).  The noise is a function of id, text and
    seed, so repeated rows tie and any of them may take a rank.  An empty table gives an empty table.
    """
    target = materialize(labelled_sample(docs, labels, "quality", limit).where("quality = 1"), "target")
    if keep is None:
        keep = labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
        keep = 1.0 if keep is None else keep
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    scored = weigh(docs, target).withColumn("gumbel_score", F.col("log_weight") - F.log(-F.log(u)))
    ranked = global_rank(scored, [F.col("gumbel_score").desc(), F.col("doc_id").asc(), F.col("text_key").asc()])
    return (ranked.withColumn("selected", F.col("rank") < F.round(F.col("total") * keep)).drop("total"))
