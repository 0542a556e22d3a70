"""Bulk scoring as a Structured Streaming job.

The original scores customer files uploaded one at a time.  Here a directory of such files is a file
stream of paths; each micro-batch reads its files (at most ``max_files_per_trigger``) by their own
headers, so any subset of the columns may come in any order and under the original names.  Rows are aligned to the
model's 31 inputs (absent columns → 0), scored by the persisted model, banded, given their top
attribution factor, and written as the batch's part of a Parquet table.  Malformed cells and unknown columns of
the batch's files go to a side table, as the same batch's part.  A batch that is repeated after a
failure overwrites its own parts; progress lives in the checkpoint location (under
``spark.checkpoint.dir``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import ensemble as EN
from ..operators import scoring as SC
from ..operators.features import model_matrix
from ..sources.readers import read_scoring_input, rejected_cells


def score_uploads(spark: SparkSession, paths: list[str], scorer, threshold: float) -> DataFrame:
    """Files with any columns → aligned features, probability, band, decision and top factor."""
    aligned = [model_matrix(read_scoring_input(spark, p), label=None) for p in paths]
    scored = SC.add_bands(scorer.predict(reduce(DataFrame.unionByName, aligned)), threshold)
    return scorer.with_top_factor(scored)


def start_scoring(spark: SparkSession, upload_dir: str, out_dir: str, checkpoint_dir: str, model,
                  threshold: float, available_now: bool = True, max_files_per_trigger: int = 16,
                  rejected_dir: str | None = None):
    """Start the stream into ``out_dir/batch_id=…``; ``available_now`` processes what is
    there and stops (batch-like), otherwise it keeps polling for new uploads.

    ``model`` is an ``ensemble.Ensemble`` or a fitted pipeline, whose leaves are read once, here.
    """
    scorer = model if hasattr(model, "with_top_factor") else EN.Fitted(model, spark)
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files_per_trigger)
             .load(upload_dir).select("path"))       # only the names: the contents are not read here

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            if rejected_dir:
                bad = reduce(DataFrame.unionByName, [rejected_cells(batch.sparkSession, p) for p in paths])
                bad.write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}")
            score_uploads(batch.sparkSession, paths, scorer, threshold).write.mode("overwrite").parquet(
                f"{out_dir}/batch_id={batch_id}")

    q = files.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
