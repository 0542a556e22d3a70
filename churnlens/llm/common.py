"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Rows and bytes in an Arrow batch: texts can be very long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: The characters that separate words: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def prepare_python(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the Arrow batches of long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage at a point that survives lost executors; every later use scans the files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once what was made of them is itself written."""
    for t in tables:
        files = t.inputFiles()
        if files:
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(col: str = "text") -> Column:
    """64-bit digest of a text (null as empty): with the id it names one row's content."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def words(col: str | Column) -> Column:
    """Words between runs of space, \\t \\n \\v \\f \\r; an empty array for null and blank texts."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_BREAK, -1), lambda w: w != F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
