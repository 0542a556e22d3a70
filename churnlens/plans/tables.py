"""Table access for named query plans.

The feature job (driver tables → activity / loyalty → 31-feature table) is
the process boundary of the original application: it writes the feature table
once and every report reads it.  Here the same: :func:`features` computes the
table from the raw tables; :func:`feature_store` writes it once to the shared
checkpoint directory (keyed by the input files and by the code that derives
it) and returns a scan of that Parquet, so report plans start from the
materialised table instead of re-planning and re-running the whole feature job.
Activity and features are stored bucketed by customer: the feature
aggregate, the joins by customer and the trend need no exchange on that key.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as FT
from ..operators import split as SP
from ..session import ensure_checkpoint_dir
from ..sources import adapter

_INPUTS = ("customer", "nation", "region", "orders", "lineitem")
_CODE = ("sources/adapter.py", "operators/features.py", "functions/expressions.py", "schemas.py")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.activity(spark, sf_dir)


def loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.loyalty(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature job, computed from the driver tables."""
    return FT.feature_table(activity(spark, sf_dir), loyalty(spark, sf_dir))


def fingerprint(spark: SparkSession, sf_dir: str, tables=_INPUTS, code=_CODE) -> str:
    """Digest of every input file (path, length, time; from the store that Spark reads) and of the code."""
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parts = []
    for t in tables:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        found = fs.listFiles(p, True)
        files = []
        while found.hasNext():
            f = found.next()
            files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        parts.append(sorted(files))
    for c in code:
        with open(os.path.join(pkg, c), "rb") as fh:
            parts.append(hashlib.sha1(fh.read()).hexdigest())
    return hashlib.sha1(json.dumps(parts).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_STORE: dict = {}
_KEY = "loyalty_number"


def _buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def _name(path: str) -> str:
    return "churnlens_" + hashlib.sha1(path.encode()).hexdigest()[:20]


def _table(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """The files of ``path`` as a table bucketed by customer: a name of this session, no copy."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"CLUSTERED BY ({_KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """Parquet files bucketed by customer, so that later aggregates and joins by customer need no exchange.  They
    are not sorted: the aggregates hash, and sorting took a third of the feature job's time.  A frame that is already
    hash-partitioned by customer is written as it lies.  The files are a table of this session under :func:`_name`."""
    df.write.format("parquet").bucketBy(buckets, _KEY).option("path", path).saveAsTable(_name(path))


def _materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    print_of = fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, print_of, name)
    if key in _STORE:
        return _table(spark, *_STORE[key])
    n = _buckets(spark)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-tables/{print_of}"
    final = f"{root}/{name}-{n}"
    fs, p = _fs(spark, f"{final}/_SUCCESS")
    if not fs.exists(p):
        tmp = f"{root}/_tmp-{name}-{uuid.uuid4().hex}"
        write_bucketed(build(), tmp, n)
        spark.sql(f"DROP TABLE {_name(tmp)}")         # an outside table: only the name goes, the files stay
        fs_t, pt = _fs(spark, tmp)
        _, pf = _fs(spark, final)
        if fs.exists(pf) and not fs.exists(p):      # left by a writer that did not finish
            fs.delete(pf, True)
        if not fs.exists(p) and not fs_t.rename(pt, pf) and not fs.exists(p):
            raise RuntimeError(f"could not move {tmp} to {final}")
    _STORE[key] = (final, spark.read.parquet(final).schema, n)
    return _table(spark, *_STORE[key])


def activity_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer-month activity table, written once and read back."""
    return _materialized(spark, sf_dir, "activity", lambda: activity(spark, sf_dir))


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, written once (from the stored activity) and read back."""
    return _materialized(spark, sf_dir, "features",
                         lambda: FT.feature_table(activity_store(spark, sf_dir), loyalty(spark, sf_dir)))


_CUTS: dict = {}


def split_cuts(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """The cuts of the whole customer table's split, found once per table."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir))
    if key not in _CUTS:
        _CUTS[key] = SP.split_cuts(feature_store(spark, sf_dir).select("loyalty_number", "churn"))
    return _CUTS[key]


def with_split(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df`` with the split of the whole customer table."""
    return SP.assign_split(df, cuts=split_cuts(spark, sf_dir))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: engines differ in the last bits);
    ``+ 0.0`` folds a negative zero into zero."""
    return df.select([(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                      if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                      for f in df.schema.fields])


def build_tables(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """Run the feature job now: write activity and features under ``root`` (a fresh
    folder in the shared checkpoint directory by default) and make the plans of
    this process read them."""
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-tables/run-{uuid.uuid4().hex}"
    n = _buckets(spark)
    own = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir))
    frame = activity(spark, sf_dir)
    write_bucketed(frame, f"{root}/activity", n)
    _STORE[(*own, "activity")] = (f"{root}/activity", frame.schema, n)
    frame = FT.feature_table(_table(spark, *_STORE[(*own, "activity")]), loyalty(spark, sf_dir))
    write_bucketed(frame, f"{root}/features", n)
    _STORE[(*own, "features")] = (f"{root}/features", frame.schema, n)
    return root
