"""Writers.  Every writer is a distributed ``DataFrameWriter`` call; nothing is
collected to the driver.  CSV exports keep the original header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import money, py_fixed, py_percent


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """IO4 / IO5 — feature table, held-out split (key + features + label)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_table(df: DataFrame, path: str) -> None:
    """IO6 — metadata tables are a handful of rows: one file is enough."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """IO7 — fitted ``PipelineModel`` / MLlib model."""
    model.write().overwrite().save(path)


def write_attributions(values: DataFrame, base: DataFrame, path: str) -> None:
    """IO8 — attributions (long rows, or one array per customer) + one-row base value."""
    values.write.mode("overwrite").parquet(f"{path}/values")
    base.coalesce(1).write.mode("overwrite").parquet(f"{path}/base")


def scoring_template(spark: SparkSession, n_features: int = 20) -> DataFrame:
    """IO10 — key + the first 20 features, one all-zero sample row."""
    values = [100001] + [0.0] * n_features
    return spark.createDataFrame([tuple(values)], ["Loyalty Number"] + S.FEATURES[:n_features])


def export_scored(scored: DataFrame, path: str) -> None:
    """IO11 — full scored table as CSV."""
    write_csv(scored, path)


def export_high_risk(scored: DataFrame, path: str) -> None:
    """IO12 — High band only."""
    write_csv(scored.where(F.col("risk_level") == "High"), path)


def format_action_list(actions: DataFrame) -> DataFrame:
    """IO13 — the four exported columns, renamed and formatted as displayed."""
    return actions.select(
        F.col("customer_id").alias("Customer ID"),
        money("clv").alias("CLV"),
        py_percent("churn_probability", 1).alias("Churn Risk"),
        F.col("recommended_actions").alias("Recommended Actions"),
    )


def export_action_list(actions: DataFrame, path: str) -> None:
    write_csv(format_action_list(actions), path)


def format_summary_report(summary: DataFrame, date: str | None = None, seconds: float | None = None) -> DataFrame:
    """IO14 — the plain-text scoring summary rendered from the one-row summary, line by line as in the original.

    The lines of the date and of the processing time are there if given.
    """
    def band(name: str) -> str:
        return F.concat(F.format_number(name, 0), F.lit(" ("), py_fixed(f"{name}_pct", 1), F.lit("%)"))

    # FIXED VALUES: the texts must equal the original's.
    lines = [F.lit("Batch Prediction Summary Report"), F.lit("================================")]
    lines += [F.lit(f"Date: {date}")] if date else []
    lines += [F.lit(""), F.concat(F.lit("Total Customers Processed: "), F.format_number("total", 0))]
    lines += [F.lit(f"Processing Time: {seconds:.2f} seconds")] if seconds is not None else []
    lines += [F.lit(""), F.lit("Risk Distribution:"),
              F.concat(F.lit("- High Risk (>60%): "), band("high")),
              F.concat(F.lit("- Medium Risk (30-60%): "), band("medium")),
              F.concat(F.lit("- Low Risk (<30%): "), band("low")), F.lit(""),
              F.concat(F.lit("Average Churn Probability: "), py_percent("mean_probability", 1)),
              F.concat(F.lit("Median Churn Probability: "), py_percent("median_probability", 1)), F.lit(""),
              F.concat(F.lit("Threshold Used: "), py_fixed("threshold", 2)), F.lit("")]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))
