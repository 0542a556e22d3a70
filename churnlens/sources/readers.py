"""Readers: raw CSV / Parquet inputs with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def _rename(df: DataFrame, headers: dict) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(headers.get(c, c)) for c in df.columns])


def _read_with_headers(spark: SparkSession, path: str, schema: T.StructType, headers: dict,
                       fmt: str) -> DataFrame:
    if fmt == "parquet":
        df = _rename(spark.read.parquet(path), headers)
        return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])
    # CSV: read with the original header names and types, then rename.
    inverse = {v: k for k, v in headers.items()}
    csv_schema = T.StructType([T.StructField(inverse.get(f.name, f.name), f.dataType, True)
                               for f in schema.fields])
    df = (spark.read.schema(csv_schema).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").csv(path))
    return _rename(df, headers)


def read_activity(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO1 — customer-month activity."""
    return _read_with_headers(spark, path, S.ACTIVITY, S.ACTIVITY_HEADERS, fmt)


def read_loyalty(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO2 — one row per customer."""
    return _read_with_headers(spark, path, S.LOYALTY, S.LOYALTY_HEADERS, fmt)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """IO3 — the written feature table."""
    return spark.read.parquet(path)


def _raw_upload(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.option("header", True)
    df = reader.parquet(path) if fmt == "parquet" else reader.csv(path)
    return _rename(df, {**S.FEATURE_HEADERS, "Loyalty Number": "loyalty_number"})


def _typed(c: str) -> str:
    return f"try_cast(`{c}` as {'bigint' if c == 'loyalty_number' else 'double'})"


def _scoring_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "loyalty_number" or c in S.FEATURES]


def read_scoring_input(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO9 — customers with any subset of the feature columns (header CSV).

    Values are read as strings and cast to double so an absent or malformed
    cell becomes NULL, which the model guard then maps to 0.
    """
    df = _raw_upload(spark, path, fmt)
    known = _scoring_columns(df)
    return df.select([F.expr(_typed(c)).alias(c) if c in known else F.col(f"`{c}`") for c in df.columns])


def rejected_cells(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO9 — what an upload holds that scoring can't take: ``(file, loyalty_number, column, raw, reason)``.

    A malformed cell is one whose text is no number (it is scored as 0); the key is given as its raw text.
    A column that scoring doesn't know is one row per file, without key and text.  Blank cells are missing
    values, not malformed.
    """
    df = _raw_upload(spark, path, fmt)
    known = _scoring_columns(df)
    file = F.col("_metadata.file_path").alias("file")
    key = F.col("loyalty_number").cast("string") if "loyalty_number" in known else F.lit(None).cast("string")
    cells = ", ".join(f"CASE WHEN trim(CAST(`{c}` AS STRING)) <> '' AND {_typed(c)} IS NULL THEN "
                      f"named_struct('column', '{c}', 'raw', CAST(`{c}` AS STRING)) END" for c in known)
    out = None
    if known:
        out = (df.select(file, key.alias("loyalty_number"), F.expr(f"filter(array({cells}), x -> x IS NOT NULL)").alias("_bad"))
               .where(F.size("_bad") > 0).select("file", "loyalty_number", F.explode("_bad").alias("_c"))
               .select("file", "loyalty_number", "_c.column", "_c.raw", F.lit("malformed").alias("reason")))
    unknown = [c for c in df.columns if c not in known]
    if unknown or out is None:
        none = F.lit(None).cast("string")
        extra = (df.select(file).distinct().select("file", none.alias("loyalty_number"),
                 F.explode(F.array([F.lit(c) for c in unknown]).cast("array<string>")).alias("column"), none.alias("raw"),
                 F.lit("unknown column").alias("reason")))
        out = extra if out is None else out.unionByName(extra)
    return out


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """IO6 — metadata tables (thresholds, metrics, parameters, feature list)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_threshold(spark: SparkSession, path: str, model: str = "gbt") -> DataFrame:
    """Decision threshold of ``model``; 0.5 when the model has no stored value.

    Returns a one-row DataFrame (joinable as a scalar) rather than a driver value.
    """
    stored = read_json_table(spark, path, T.StructType([T.StructField("model", T.StringType()),
                                                        T.StructField("threshold", T.DoubleType())]))
    return (stored.where(F.col("model") == model).agg(F.max("threshold").alias("threshold"))
            .select(F.coalesce("threshold", F.lit(S.DEFAULT_THRESHOLD)).alias("threshold")))


def read_attributions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO8 — long attribution table and the one-row base value table."""
    return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/base")
