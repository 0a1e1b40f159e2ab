"""Orders of a province are counted without a set of them in one buffer."""

import datetime as dt
from decimal import Decimal

from tidemark.plans import dws


def test_province_orders(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at, 1, k // 2, Decimal("1.00")) for k in range(1_000)] + [(at, 1, None, Decimal("1.00")), (at, 2, None, Decimal("2.00"))]
    amounts = spark.createDataFrame(rows, "row_time timestamp_ntz, province_id long, order_id long, order_amount decimal(16,2)")
    provinces = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    out = dws.province_order(amounts, provinces)
    assert sorted((r["province_id"], r["province_name"], r["order_count"], r["order_amount"]) for r in out.collect()) == [(1, "a", 500, 1001), (2, "b", 0, 2)]
    assert "collect_set" not in out._jdf.queryExecution().executedPlan().toString()
