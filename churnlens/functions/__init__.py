from .expressions import (  # noqa: F401
    col, compare, decision, lookup, model_input, money, month_index, null_safe_flag,
    py_fixed, py_grouped, py_percent, rate_band, risk_band, safe_div, status_label,
    title_case, year_month_key,
)
