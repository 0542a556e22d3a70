"""churnlens — customer-churn analytics expressed as Spark DataFrame plans.

Layout
------
sources/    readers, writers and the TPC-H → activity/loyalty adapter
functions/  column expressions (guarded ratios, bands, encoders, formatting)
operators/  DataFrame → DataFrame operators (features, reports, evaluation,
            scoring, attribution, retention, training)
plans/      named query plans over a table directory (+ DuckDB oracle SQL)
streaming/  Structured Streaming form of bulk scoring
"""

__version__ = "0.1.0"
