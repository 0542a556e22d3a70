import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s


def activity_rows(key, months, flights=0.0, **kw):
    """24-month grid rows for one customer; ``months`` maps month index → flights."""
    rows = []
    for i in range(24):
        y, m = 2017 + i // 12, i % 12 + 1
        f = float(months.get(i + 1, flights))
        rows.append((key, y, m, f, f, kw.get("companions", 0.0), kw.get("distance", 10.0) * f,
                     kw.get("acc", 100.0) * (1 if f else 0), kw.get("red", 0.0), kw.get("dollar", 0.0)))
    return rows


ACT_SCHEMA = ("loyalty_number long, year int, month int, total_flights double, flights_booked double, "
              "companion_flights double, distance double, points_accumulated double, points_redeemed double, "
              "dollar_points_redeemed double")
LOY_SCHEMA = ("loyalty_number long, country string, province string, gender string, education string, "
              "salary double, marital_status string, loyalty_card string, clv double, enrollment_type string, "
              "enrollment_year int, enrollment_month int, cancellation_year int")
