"""Scalar column expressions.  All are JVM-side (codegen), no Python UDFs.

Missing values follow the original pandas semantics (SURVEY §1.3): a missing
value compares false, guarded ratios fall back to 0, and ANSI mode never sees
a division by zero because every quotient sits behind its own guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, cond: Column | None = None, default: float = 0.0) -> Column:
    """``num / den`` where ``cond`` (default ``den > 0``) holds, else ``default``."""
    num, den = col(num), col(den)
    guard = (den > 0) if cond is None else cond
    return F.when(guard, num / den).otherwise(F.lit(default))


def null_safe_flag(c, value) -> Column:
    """1 when ``c == value``; 0 for other values *and* for NULL (pandas ``==``)."""
    return F.coalesce((col(c) == F.lit(value)).cast("int"), F.lit(0))


def lookup(c, mapping: dict, dtype: str = "double") -> Column:
    """Dictionary map: unknown or missing keys give NULL (pandas ``Series.map``)."""
    c = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.cast(dtype)


def month_index(year="year", month="month", base_year: int = S.BASE_YEAR) -> Column:
    """Base year → month (1..12); the following year → month + 12."""
    return F.when(col(year) == base_year, col(month)).otherwise(col(month) + 12)


def year_month_key(year="year", month="month") -> Column:
    """``YYYY-MM`` with a zero-padded month."""
    return F.format_string("%d-%02d", col(year), col(month))


def status_label(churn="churn") -> Column:
    return F.when(col(churn) == 0, F.lit(S.STATUS_LABELS[0])).when(col(churn) == 1, F.lit(S.STATUS_LABELS[1]))


def risk_band(p="churn_probability", high: float = S.RISK_HIGH, medium: float = S.RISK_MEDIUM) -> Column:
    p = col(p)
    return F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low")


def decision(p="churn_probability", threshold=S.DEFAULT_THRESHOLD) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col(p) >= t).cast("int")


def rate_band(rate, high: float, elevated: float) -> Column:
    """Severity band of a percentage (names only; presentation colours are not kept)."""
    r = col(rate)
    return F.when(r > high, "High").when(r > elevated, "Elevated").otherwise("Normal")


def model_input_sql(name: str) -> str:
    """SQL text of the model guard (NULL, NaN, ±inf → 0) for column ``name``.

    Wide projections are built from SQL text: one JVM call parses all of them
    instead of one py4j round trip per expression node.
    """
    x = f"CAST(`{name}` AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = CAST('Infinity' AS DOUBLE) "
            f"OR {x} = CAST('-Infinity' AS DOUBLE) THEN 0D ELSE {x} END")


def model_input(c) -> Column:
    """Model guard: NULL → 0, NaN → 0, ±inf → 0."""
    if isinstance(c, str):
        return F.expr(model_input_sql(c))
    c = c.cast("double")
    bad = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(c.isNull() | bad, F.lit(0.0)).otherwise(c)


def title_case(c) -> Column:
    """Python ``str.title`` on ``_``-separated names: each letter after a non-letter is upper."""
    chars = F.split(F.regexp_replace(col(c), "_", " "), "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike("[A-Za-z]"),
        F.upper(ch)).otherwise(F.lower(ch))), "")


def py_fixed(x, digits: int) -> Column:
    """Python ``f"{x:.Nf}"``: correctly rounded (half-even on the exact binary value)."""
    return F.regexp_replace(F.format_number(col(x), digits), ",", "")


def py_grouped(x, digits: int) -> Column:
    """Python ``f"{x:,.Nf}"``."""
    return F.format_number(col(x), digits)


def py_percent(x, digits: int) -> Column:
    """Python ``f"{x:.N%}"``."""
    return F.concat(py_fixed(col(x) * 100.0, digits), F.lit("%"))


def money(x, digits: int = 2) -> Column:
    """``$1,234.50`` (Python ``f"${x:,.2f}"``)."""
    return F.concat(F.lit("$"), py_grouped(x, digits))


def compare(c, op: str, bound: float) -> Column:
    c = col(c)
    return {"<": c < bound, ">": c > bound, "==": c == bound, "<=": c <= bound, ">=": c >= bound}[op]
