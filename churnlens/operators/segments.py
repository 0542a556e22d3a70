"""Portfolio, segment, trend and distribution reports over the feature table.

Every report is a single aggregate (partial + final hash aggregate) whose
output is bounded by the number of segments, never by the number of rows.
Whole-table scalars (totals, min/max bounds) are one-row aggregates attached
as a scalar subquery — evaluated once, no join and no row fan-out.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import col, rate_band, status_label, year_month_key

_SCALAR = "__scalar"


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (a global aggregate) to every row.

    The row is a scalar subquery (``DataFrame.scalar``) of one struct: Spark
    evaluates it once and inlines the value — no join, no cross product.
    """
    cols = one_row.columns
    s = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias(_SCALAR)).scalar()
    return (df.withColumn(_SCALAR, s)
            .select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(_SCALAR)[c].alias(c) for c in cols]))


def _stack(pairs: Sequence[tuple[str, Sequence[str]]], names: Sequence[str]) -> Column:
    """``stack`` expression: each pair is (label literal, [column names])."""
    parts = []
    for label, cols in pairs:
        parts.append("'" + label.replace("'", "\\'") + "'")
        parts.extend(f"`{c}`" for c in cols)
    return F.expr(f"stack({len(pairs)}, {', '.join(parts)}) as ({', '.join(names)})")


# ---------------------------------------------------------------- AG4 / AG5
def portfolio_kpis(df: DataFrame) -> DataFrame:
    """Total, churned, active, churn rate %, active %, mean / total CLV, revenue at risk."""
    agg = df.agg(F.count(F.lit(1)).alias("total_customers"),
                 F.sum("churn").alias("churned_customers"),
                 F.avg("clv").alias("avg_clv"),
                 F.sum("clv").alias("total_clv"),
                 F.sum(F.when(F.col("churn") == 1, F.col("clv"))).alias("churned_clv"))
    return agg.select(
        "total_customers", "churned_customers",
        (F.col("total_customers") - F.col("churned_customers")).alias("active_customers"),
        F.when(F.col("total_customers") > 0, F.col("churned_customers") / F.col("total_customers") * 100)
         .alias("churn_rate"),
        F.when(F.col("total_customers") > 0,
               (F.col("total_customers") - F.col("churned_customers")) / F.col("total_customers") * 100)
         .alias("active_pct"),
        "avg_clv", "total_clv", F.coalesce("churned_clv", F.lit(0.0)).alias("churned_clv"))


def tier_kpis(df: DataFrame, tiers: Sequence[str] = tuple(S.TIER_LEVELS)) -> DataFrame:
    """Customers and churn rate % per fixed tier list; 0 for an absent tier."""
    aggs = []
    for i, t in enumerate(tiers):
        hit = F.col("loyalty_card") == t
        aggs += [F.count_if(hit).alias(f"n{i}"), F.sum(F.when(hit, F.col("churn"))).alias(f"c{i}")]
    one = df.agg(*aggs)
    rates = [F.when(F.col(f"n{i}") > 0, F.col(f"c{i}") / F.col(f"n{i}") * 100).otherwise(F.lit(0.0))
             .alias(f"r{i}") for i in range(len(tiers))]
    one = one.select(*[F.col(f"n{i}") for i in range(len(tiers))], *rates)
    return one.select(_stack([(t, [f"n{i}", f"r{i}"]) for i, t in enumerate(tiers)],
                             ["tier", "customers", "churn_rate"]))


# ---------------------------------------------------------------- AG6 family
def churn_by(df: DataFrame, segment: str, alias: str = "segment",
             means: dict[str, str] | None = None, with_clv: bool = True) -> DataFrame:
    """Churned (sum), total (non-missing churn count), rate %, optional means.

    Missing segment keys are dropped (pandas group-by default).
    """
    aggs = [F.sum("churn").alias("churned"), F.count("churn").alias("total"),
            (F.avg("churn") * 100).alias("churn_rate")]
    if with_clv:
        aggs.append(F.avg("clv").alias("avg_clv"))
    for name, c in (means or {}).items():
        aggs.append(F.avg(c).alias(name))
    return (df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).alias(alias)).agg(*aggs))


def churn_by_tier(df: DataFrame) -> DataFrame:
    """AG7 / AG12 — tier table: churned, active, total, rate, mean CLV, mean flights."""
    return (churn_by(df, "loyalty_card", "tier", {"avg_flights": "total_flights_24m"})
            .withColumn("active", F.col("total") - F.col("churned"))
            .orderBy("churn_rate", "tier"))


def churn_by_enrollment(df: DataFrame) -> DataFrame:
    """AG8 — per enrollment type + share of all churned (donut) + severity band."""
    g = churn_by(df, "enrollment_type", "enrollment_type")
    total = g.agg(F.sum("churned").alias("_all_churned"))
    hi, el = S.ENROLLMENT_RATE_BANDS
    return (attach_scalar(g, total)
            .withColumn("churn_share", F.when(F.col("_all_churned") > 0,
                                              F.col("churned") / F.col("_all_churned") * 100))
            .withColumn("rate_band", rate_band("churn_rate", hi, el))
            .drop("_all_churned"))


def churn_by_education(df: DataFrame) -> DataFrame:
    """AG13 — ordered by education rank, unknown levels last (rank 99)."""
    return (churn_by(df, "education", "education", with_clv=False)
            .withColumn("education_rank", F.expr(
                "coalesce(nullif(array_position(array(" + ", ".join(f"'{k}'" for k in S.EDUCATION_LEVELS)
                + "), education), 0) - 1, 99)").cast("int"))
            .orderBy("education_rank", "education"))


def monthly_trend(activity: DataFrame, labels: DataFrame) -> DataFrame:
    """AG9 — mean monthly flights per (YYYY-MM, status); rows without a label drop out.

    ``labels`` has one row per customer, so this is an N:1 equi-join; AQE picks
    a broadcast only if the label table is measured small at run time.
    """
    j = activity.join(labels.select("loyalty_number", "churn"), "loyalty_number")
    # grouped by the numbers; the text key is made once per group
    g = (j.where(F.col("churn").isNotNull())
         .groupBy("year", "month", "churn").agg(F.avg("total_flights").alias("avg_flights"))
         .select(year_month_key("year", "month").alias("month_year"), "churn", "avg_flights"))
    ann = g.agg((F.max(F.when(F.col("churn") == 0, F.col("avg_flights"))) * 0.9).alias("annotation_y"))
    return attach_scalar(g.withColumn("status", status_label("churn")), ann)


def province_report(df: DataFrame, country: str = "Canada", k: int = 10) -> DataFrame:
    """AG10 — one country: churned, total, rate; top k by total (name breaks ties); band."""
    g = churn_by(df.where(F.col("country") == country), "province", "province", with_clv=False)
    hi, el = S.PROVINCE_RATE_BANDS
    top = g.orderBy(F.desc("total"), F.asc("province")).limit(k)
    return top.withColumn("rate_band", rate_band("churn_rate", hi, el)).orderBy("churn_rate", "province")


# ---------------------------------------------------------------- AG14
SEGMENT_DIMENSIONS = {
    "tier": "loyalty_card", "enrollment_type": "enrollment_type", "gender": "gender",
    "education": "education", "marital_status": "marital_status", "province": "province",
}


def segment_grouping_sets(df: DataFrame, dims: dict[str, str] = SEGMENT_DIMENSIONS) -> DataFrame:
    """All segment reports in one pass: GROUPING SETS over the segment columns.

    One scan and one shuffle replace one group-by per chart.
    """
    cols = list(dims.values())
    g = df.groupingSets([[c] for c in cols], *cols).agg(
        F.sum("churn").alias("churned"), F.count("churn").alias("total"),
        (F.avg("churn") * 100).alias("churn_rate"), F.avg("clv").alias("avg_clv"),
        F.avg("total_flights_24m").alias("avg_flights"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    dim = None
    seg = None
    for name, c in dims.items():
        hit = F.col(f"_g_{c}") == 0
        dim = F.when(hit, F.lit(name)) if dim is None else dim.when(hit, F.lit(name))
        seg = F.when(hit, F.col(c).cast("string")) if seg is None else seg.when(hit, F.col(c).cast("string"))
    return (g.select(dim.alias("dimension"), seg.alias("segment"), "churned", "total",
                     "churn_rate", "avg_clv", "avg_flights")
            .where(F.col("segment").isNotNull()))


# ---------------------------------------------------------------- FI4–FI10
def filter_domains(df: DataFrame) -> DataFrame:
    """FI10 — filter option domains and slider bounds in one job (one row)."""
    def levels(c):
        return F.array_join(F.array_sort(F.collect_set(c)), "|")
    return df.agg(
        levels("loyalty_card").alias("tiers"),
        levels("enrollment_type").alias("enrollment_types"),
        levels("province").alias("provinces"),
        F.min("salary").cast("long").alias("salary_min"), F.max("salary").cast("long").alias("salary_max"),
        F.min("tenure_months").cast("long").alias("tenure_min"),
        F.max("tenure_months").cast("long").alias("tenure_max"),
        F.min("loyalty_number").alias("key_min"), F.max("loyalty_number").alias("key_max"))


def filter_values(df: DataFrame) -> DataFrame:
    """FI10 — the filters' options as rows ``(dimension, value)``, and the sliders' bounds as their texts."""
    options = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (
        ("tier", "loyalty_card"), ("enrollment_type", "enrollment_type"), ("province", "province"))])).alias("_o"))
    options = options.where(F.col("_o.value").isNotNull()).select("_o.dimension", "_o.value").distinct()
    ends = df.agg(*[f(c).cast("long").alias(f"{c}_{n}") for c in ("salary", "tenure_months", "loyalty_number")
                    for n, f in (("min", F.min), ("max", F.max))])
    bounds = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ends.columns])).alias("_o"))
    return options.unionByName(bounds.select("_o.dimension", "_o.value"))


def segment_condition(tiers: Iterable[str] | None = None, enrollment_types: Iterable[str] | None = None,
                      provinces: Iterable[str] | None = None,
                      salary_range: tuple | None = None, tenure_range: tuple | None = None) -> Column:
    """FI4–FI6 predicate.  ``None`` = option left at its default:

    * tiers / enrollment types default to *all* (no filter); an empty list selects nothing;
    * provinces default to none selected = no filter; an empty list is also no filter;
    * salary / tenure default to ``[int(min), int(max)]`` of the whole table
      (columns ``salary_min`` … attached by :func:`filter_segment`); a missing
      salary never passes a range filter.
    """
    cond = F.lit(True)
    if tiers is not None:
        cond = cond & F.col("loyalty_card").isin(list(tiers)) if tiers else F.lit(False)
    if enrollment_types is not None:
        et = list(enrollment_types)
        cond = (cond & F.col("enrollment_type").isin(et)) if et else F.lit(False)
    if provinces:
        cond = cond & F.col("province").isin(list(provinces))
    s_lo, s_hi = salary_range if salary_range else (F.col("salary_min"), F.col("salary_max"))
    t_lo, t_hi = tenure_range if tenure_range else (F.col("tenure_min"), F.col("tenure_max"))
    cond = cond & (F.col("salary") >= s_lo) & (F.col("salary") <= s_hi)
    cond = cond & (F.col("tenure_months") >= t_lo) & (F.col("tenure_months") <= t_hi)
    return cond


def filter_segment(df: DataFrame, **options) -> DataFrame:
    """Rows passing the segment filters (default bounds from the whole table)."""
    bounds = df.agg(F.min("salary").cast("long").alias("salary_min"),
                    F.max("salary").cast("long").alias("salary_max"),
                    F.min("tenure_months").cast("long").alias("tenure_min"),
                    F.max("tenure_months").cast("long").alias("tenure_max"))
    return (attach_scalar(df, bounds).where(segment_condition(**options))
            .drop("salary_min", "salary_max", "tenure_min", "tenure_max"))


def segment_filtered_kpis(df: DataFrame, **options) -> DataFrame:
    """AG11 + FI9 — filtered-of-total count and the filtered header in one aggregate.

    Rates and means are NULL when nothing passes (the empty-result guard).
    """
    bounds = df.agg(F.min("salary").cast("long").alias("salary_min"),
                    F.max("salary").cast("long").alias("salary_max"),
                    F.min("tenure_months").cast("long").alias("tenure_min"),
                    F.max("tenure_months").cast("long").alias("tenure_max"))
    keep = F.coalesce(segment_condition(**options), F.lit(False))
    return attach_scalar(df, bounds).agg(
        F.count_if(keep).alias("filtered_customers"),
        F.count(F.lit(1)).alias("total_customers"),
        (F.avg(F.when(keep, F.col("churn"))) * 100).alias("churn_rate"),
        F.avg(F.when(keep, F.col("clv"))).alias("avg_clv"),
        F.avg(F.when(keep, F.col("total_flights_24m"))).alias("avg_flights"))


# ---------------------------------------------------------------- AG15 / AG16
def histogram(df: DataFrame, value: str, bins: int, by: str | None = "churn",
              domain: tuple[float, float] | None = None, marker: float | None = None) -> DataFrame:
    """AG15 / AG16 — exact equal-width histogram (per status when ``by`` is given),
    with the mean of the values (the chart's mean line) and an optional fixed
    marker (e.g. the decision threshold on a probability histogram).

    Bounds come from a one-row min/max aggregate unless a fixed ``domain`` is
    given; the top edge is closed.  Output is bounded by ``bins`` × statuses.
    """
    from pyspark.sql import Window
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull())
    if domain is None:
        base = attach_scalar(base, df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    else:
        base = base.withColumn("_lo", F.lit(float(domain[0]))).withColumn("_hi", F.lit(float(domain[1])))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width * bins) + 1, F.lit(bins))) \
         .otherwise(F.lit(1)).cast("long")
    b = F.greatest(b, F.lit(1))
    keys = [b.alias("bin")]
    if by:
        keys = [status_label(by).alias("status")] + keys
    g = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("_sum"),
                                F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    # the mean comes from the per-bin sums: a window over ≤ bins rows per status
    per = Window.partitionBy("status") if by else Window.partitionBy()
    out = g.select(*(["status"] if by else []), "bin",
                   (F.col("_lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                   (F.col("_lo") + F.col("bin") * w).alias("bin_hi"), "count",
                   (F.sum("_sum").over(per) / F.sum("count").over(per)).alias("mean"))
    return out.withColumn("marker", F.lit(float(marker))) if marker is not None else out


# ---------------------------------------------------------------- SO / SA
def top_k(df: DataFrame, order_col: str, k: int, key: str = "loyalty_number",
          ascending: bool = False) -> DataFrame:
    """SO3 / SO4 — top-k with a key tie-break (distributed take-ordered)."""
    o = F.asc(order_col) if ascending else F.desc(order_col)
    return df.orderBy(o, F.asc(key)).limit(k)


def customer_lookup(df: DataFrame, key_value: int, key: str = "loyalty_number") -> DataFrame:
    """FI8 — one customer by key; empty when absent."""
    return df.where(F.col(key) == F.lit(key_value)).limit(1)


def balanced_sample(df: DataFrame, n: int, seed: int = S.SPLIT_SEED, label: str = "churn",
                    key: str = "loyalty_number") -> DataFrame:
    """SA1 — up to n/2 rows per class, chosen by a seeded hash of the key
    (md5 of "<key>-<seed>", portable to SQL), shuffled by the same hash.

    Each class is a distributed top-k over the hash, not a per-class window.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    parts = [df.where(F.col(label) == c).withColumn("_h", h).orderBy("_h").limit(n // 2)
             for c in (1, 0)]
    return parts[0].unionByName(parts[1]).orderBy("_h").drop("_h")


def showcase_ids(df: DataFrame, seed: int = S.SPLIT_SEED, key: str = "loyalty_number") -> DataFrame:
    """SA2 — top 5 by CLV ∪ up to 5 churned (seeded), distinct, at most 10 ids."""
    top = top_k(df, "clv", 5, key).select(key)
    churned = balanced_sample(df.where(F.col("churn") == 1), 10, seed).select(key)
    return top.unionByName(churned).distinct().orderBy(key).limit(10)
