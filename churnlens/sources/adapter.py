"""Driver tables (TPC-H-like) → the two inputs of the churn model.

``activity``: one row per customer-month over a 24-month window, dense (months
without lines are zero rows), built from ``orders ⋈ lineitem``.
``loyalty``: one row per customer from ``customer ⋈ nation ⋈ region`` plus the
customer's first / last order date.  See FIXTURES.md §2 for the mapping.

Plan shape (scale notes):
* ``orders`` is filtered on the window before the join (pushed to the scan);
  lineitem is pruned to five columns.  The join is a sort-merge on the order
  key; AQE splits a skewed order key.
* The monthly aggregate is a partial + final hash aggregate on
  (customer, year, month), so a customer with a third of all lines costs one
  partial row per map task, not a hot reducer.
* Densifying needs no cross join: the ≤24 monthly rows of a customer are
  gathered into a map keyed by month slot (bounded by the calendar, not the
  data), then 24 rows are generated per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# FIXED VALUES of the adapter (FIXTURES.md §2).
WINDOW_START = "1999-01-01"
WINDOW_END = "2001-01-01"
YEAR_SHIFT = 18                  # 1999 → 2017, 2000 → 2018
CHURN_CUTOFF = "2000-07-01"      # last order before this date → cancelled
REDEEM_DISCOUNT = 0.075
EDUCATION_BY_MOD6 = [None, "High School or Below", "College", "Bachelor", "Master", "Doctor"]
MARITAL_BY_MOD3 = ["Divorced", "Married", "Single"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _typed_literal(df: DataFrame, column: str, value: str):
    """A literal of the column's own type so the comparison is pushed to the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def activity_from_tpch(orders: DataFrame, lineitem: DataFrame, base_year: int = S.BASE_YEAR,
                       window_start: str = WINDOW_START, window_end: str = WINDOW_END,
                       year_shift: int = YEAR_SHIFT) -> DataFrame:
    o = (orders
         .where((F.col("o_orderdate") >= _typed_literal(orders, "o_orderdate", window_start))
                & (F.col("o_orderdate") < _typed_literal(orders, "o_orderdate", window_end)))
         .select("o_orderkey", "o_custkey", "o_orderdate"))
    li = lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    j = li.join(o, li.l_orderkey == o.o_orderkey)

    points = F.floor(F.col("l_extendedprice") / 100)
    dollars = F.floor(F.col("l_extendedprice") / 1000)
    redeem = F.col("l_discount") > REDEEM_DISCOUNT
    sparse = (j.groupBy(F.col("o_custkey").cast("long").alias("loyalty_number"),
                        (F.year("o_orderdate") + year_shift).alias("year"),
                        F.month("o_orderdate").alias("month"))
              .agg(F.count(F.lit(1)).alias("total_flights"),
                   F.count_if(F.col("l_returnflag") != "R").alias("flights_booked"),
                   F.count_if(F.col("l_returnflag") == "R").alias("companion_flights"),
                   F.sum("l_quantity").alias("distance"),
                   F.sum(points).alias("points_accumulated"),
                   F.sum(F.when(redeem, points).otherwise(0)).alias("points_redeemed"),
                   F.sum(F.when(redeem, dollars).otherwise(0)).alias("dollar_points_redeemed")))
    return densify(sparse, base_year)


_METRICS = ["total_flights", "flights_booked", "companion_flights", "distance",
            "points_accumulated", "points_redeemed", "dollar_points_redeemed"]


def densify(sparse: DataFrame, base_year: int = S.BASE_YEAR,
            months: int = S.OBSERVATION_MONTHS) -> DataFrame:
    """Every customer present in ``sparse`` × every month of the window; gaps are 0."""
    slot = (F.col("year") - base_year) * 12 + F.col("month") - 1
    per_customer = (sparse.where(slot.between(0, months - 1))
                    .groupBy("loyalty_number")
                    .agg(F.map_from_entries(F.collect_list(
                        F.struct(slot.alias("slot"), F.struct(*_METRICS).alias("m")))).alias("by_slot")))
    rows = F.expr(f"inline(transform(sequence(0, {months - 1}), i -> named_struct("
                  f"'year', cast({base_year} + i div 12 as int), 'month', cast(i % 12 + 1 as int), "
                  + ", ".join(f"'{m}', cast(coalesce(try_element_at(by_slot, i).{m}, 0) as double)"
                              for m in _METRICS) + ")))")
    return per_customer.select("loyalty_number", rows)


def loyalty_from_tpch(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame,
                      churn_cutoff: str = CHURN_CUTOFF, year_shift: int = YEAR_SHIFT,
                      end_year: int = S.BASE_YEAR + 1) -> DataFrame:
    first_last = (orders.groupBy("o_custkey")
                  .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")))
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions: broadcast is bounded.
    geo = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", "n_name", "r_name"))
    c = (customer.select("c_custkey", "c_nationkey", "c_acctbal")
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(first_last, F.col("c_custkey") == F.col("o_custkey"), "left"))

    cutoff = f"CAST('{churn_cutoff}' AS {orders.schema['o_orderdate'].dataType.simpleString()})"
    edu = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(EDUCATION_BY_MOD6) if v is not None)
    m0, m1, m2 = MARITAL_BY_MOD3
    # SQL text: one JVM parse for the whole projection (instead of a py4j call per node).
    return c.selectExpr(
        "CAST(c_custkey AS BIGINT) AS loyalty_number",
        "CASE WHEN r_name = 'AMERICA' THEN 'United States' ELSE 'Canada' END AS country",
        "n_name AS province",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
        f"CASE c_custkey % 6 {edu} END AS education",
        "CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey * 7919) % 100000 + 15000 END AS DOUBLE)"
        " AS salary",
        f"CASE WHEN c_custkey % 3 = 0 THEN '{m0}' WHEN c_custkey % 3 = 1 THEN '{m1}' ELSE '{m2}' END"
        " AS marital_status",
        "CASE WHEN c_custkey % 10 < 5 THEN 'Star' WHEN c_custkey % 10 < 8 THEN 'Nova' ELSE 'Aurora' END"
        " AS loyalty_card",
        "CAST(c_acctbal AS DOUBLE) AS clv",
        f"CASE WHEN c_custkey % 20 = 0 THEN '{S.PROMOTION_ENROLLMENT}' ELSE 'Standard' END AS enrollment_type",
        f"CAST(CASE WHEN c_custkey % 20 = 0 THEN {end_year} WHEN first_order IS NULL THEN {end_year - 1}"
        f" ELSE least(year(first_order) + {year_shift}, {end_year}) END AS INT) AS enrollment_year",
        "CAST(CASE WHEN c_custkey % 20 = 0 THEN c_custkey % 12 + 1 WHEN first_order IS NULL THEN 1"
        " ELSE month(first_order) END AS INT) AS enrollment_month",
        f"CAST(CASE WHEN last_order < {cutoff} THEN year(last_order) + {year_shift} END AS INT)"
        " AS cancellation_year",
    )


def activity(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return activity_from_tpch(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), **kw)


def loyalty(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return loyalty_from_tpch(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation"),
                             read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "orders"), **kw)
