"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled documents that a model is fitted on, at most.
MAX_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """``docs`` rows of a hash-ordered sample of at most ``limit`` labelled ids, with ``label`` as 0/1.

    Rows whose id or label is null take no part; an id labelled twice counts by its largest label.  The
    sample of ids is small by its bound, so it is broadcast and no text is shuffled.
    """
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max(label) > 0).cast("int").alias("__label"))
           .orderBy(F.xxhash64("__id"), "__id").limit(limit))
    ids = materialize(ids, "sample")
    return (docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("__id"))
            .select("doc_id", "text", F.col("__label").alias(label)))
