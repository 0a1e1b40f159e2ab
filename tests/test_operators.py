import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import etl, joins
from tidemark.plans import dwd, dws
from tidemark.sinks import writers
from tidemark.sources import readers
from tidemark.streaming import jobs


def changes(spark, *rows):
    return spark.createDataFrame([("db", *r) for r in rows], schemas.CDC)


DIC = [("2401", "search"), ("1101", "card"), ("1301", "size"), ("1501", "money")]


def test_dirty_and_split(spark):
    page = {"common": {"mid": "m"}, "page": {"page_id": "home"}, "ts": 1, "displays": [{"a": "1"}, {"a": "2"}], "actions": [{"b": "1"}]}
    values = [json.dumps(page), json.dumps({**page, "err": {"e": "1"}, "displays": []}), json.dumps({"common": {}, "start": {"s": "1"}, "err": {"e": "2"}, "ts": 2}), "no json", "[1]", None, ""]
    clean, dirty = etl.dirty_split(spark.createDataFrame([(v,) for v in values], "value string"))
    assert dirty.count() == 4
    parts = {k: [json.loads(r[0]) for r in v.collect()] for k, v in etl.log_split(etl.parsed(clean)).items()}
    assert {k: len(v) for k, v in parts.items()} == {"err": 2, "start": 1, "display": 2, "action": 2, "page": 2}
    assert set(parts["action"][0]) == {"common", "page", "action"} and set(parts["display"][0]) == {"common", "page", "ts", "display"}
    assert parts["start"] == [{"s": "1"}]
    odd = {"common": {"mid": "m", "is_new": "1", "os": {"v": 3}}, "page": {"page_id": "home", "extra": [1]}, "ts": 5, "displays": None, "more": True, "err": None}
    logs = etl.parsed(spark.createDataFrame([(json.dumps(odd),)], "value string"))
    page = json.loads(etl.log_split(logs)["page"].collect()[0][0])
    assert page == {k: v for k, v in odd.items() if k != "err"} and etl.log_split(logs)["err"].count() == 0  # no field is lost
    repaired = logs.select(etl.with_is_new(F.col("log"), F.lit("0")).alias("v")).collect()[0][0]
    assert json.loads(repaired) == {**odd, "common": {**odd["common"], "is_new": "0"}}


def test_cart_and_missing_types(spark):
    rows = changes(
        spark,
        ("cart_info", "insert", "1", {"id": "1", "sku_num": "2", "source_type": "2401"}, None),
        ("cart_info", "update", "2", {"id": "1", "sku_num": "5", "source_type": "2401"}, {"sku_num": "2"}),
        ("cart_info", "update", "3", {"id": "1", "sku_num": "1", "source_type": "2401"}, {"sku_num": "5"}),
        ("cart_info", "update", "4", {"id": "1", "sku_num": "x", "source_type": "2401"}, {"is_checked": "1"}),
        ("cart_info", "insert", "5", {"id": "2", "sku_num": "1", "source_type": "9"}, None),
    )
    got = dwd.cart_add(rows, spark.createDataFrame(DIC, schemas.DIC))
    assert got.columns == ["id", "user_id", "sku_id", "sku_num", "ts", "source_type", "source_type_name"]
    assert sorted(r["sku_num"] for r in got.collect()) == ["2", "3"]
    typed = spark.createDataFrame([("a",), (None,), ("bootstrap-start",)], "type string")
    assert etl.drop_types(typed, ["bootstrap-start"]).count() == 2
    assert etl.drop_types(typed, ["bootstrap-start"], keep_missing=False).count() == 1


def test_refund_tables(spark):
    dic = spark.createDataFrame(DIC, schemas.DIC)
    refund = {"id": "r", "user_id": "u", "order_id": "o", "sku_id": "s", "refund_type": "1501", "refund_num": "1", "refund_amount": "9.5", "refund_reason_type": "1301", "create_time": "2024-01-02 03:04:05", "refund_status": "0705"}
    rows = changes(
        spark,
        ("order_refund_info", "insert", "1", refund, None),
        ("order_refund_info", "update", "1", refund, {"refund_status": "0701"}),
        ("order_info", "update", "1", {"id": "o", "user_id": "u", "province_id": "p", "order_status": "1005"}, {"order_status": "1002"}),
        ("order_info", "update", "1", {"id": "o", "user_id": "u", "province_id": "p", "order_status": "1006"}, {"order_status": "1005"}),
        ("refund_payment", "insert", "1", {"id": "q", "order_id": "o", "sku_id": "s", "payment_type": "1101", "callback_time": "2024-01-03 00:00:00", "total_amount": "9.5", "refund_status": "0701"}, None),
        ("refund_payment", "insert", "1", {"id": "z", "order_id": "o", "sku_id": "other", "payment_type": "1101", "callback_time": "2024-01-03 00:00:00", "refund_status": "0701"}, None),
    )
    one = dwd.order_refund(rows, dic).collect()
    assert len(one) == 1 and one[0]["date_id"] == "2024-01-02" and one[0]["refund_type_name"] == "money" and one[0]["refund_reason_type_name"] == "size"
    paid = dwd.refund_paid(rows, dic).collect()
    assert [(r["id"], r["date_id"], r["payment_type_name"], r["refund_num"]) for r in paid] == [("q", "2024-01-03", "card", "1")]


def test_interval_is_inclusive(spark):
    emp = readers.csv_fields(spark.createDataFrame([(f"{i},e,1,{1000 + d}",) for i, d in enumerate((-6, -5, 0, 5, 6))], "value string"), schemas.EMP).withColumn("at", F.timestamp_millis("ts"))
    dept = readers.csv_fields(spark.createDataFrame([("1,d,1000",)], "value string"), schemas.DEPT).select(F.col("deptno").alias("d"), F.timestamp_millis("ts").alias("dt"))
    got = joins.interval_join(emp, dept, [("deptno", "d")], "at", "dt", "5 milliseconds", "5 milliseconds")
    assert sorted(r["empno"] for r in got.collect()) == [1, 2, 3]


def test_pay_detail(spark):
    at = datetime(2024, 1, 1, 12)
    pay = changes(spark, ("payment_info", "insert", "1704110400", {"user_id": "u", "order_id": "o", "payment_type": "1101", "callback_time": "x"}, None))
    detail = spark.createDataFrame([("d", "o")], "id string, order_id string")
    for f in schemas.ORDER_DETAIL.fieldNames()[2:]:
        detail = detail.withColumn(f, F.lit("1"))
    got = dwd.pay_detail(readers.with_event_time(pay), detail.withColumn("row_time", F.lit(at)), spark.createDataFrame(DIC, schemas.DIC))
    assert got.columns[0] == "order_detail_id" and got.columns[-2:] == ["split_payment_amount", "ts"] and got.count() == 1


def test_upsert_is_idempotent(spark, tmp_path):
    write = writers.upsert(str(tmp_path / "t"), ["id"], ["n"])
    first, second = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, n int"), spark.createDataFrame([(2, 0), (3, 1)], "id int, n int")
    for i, b in enumerate((first, second, second)):
        write(b, min(i, 1))
    assert sorted(map(tuple, writers.upserted(spark, str(tmp_path / "t"), ["id"]).collect())) == [(1, 2), (2, 0), (3, 1)]


def test_upserts_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    write = writers.upsert(path, ["id"], ["n"], every=2)
    for i in (0, 1, 2, 2, 3, 4, 5):
        write(spark.createDataFrame([(i, i), (99, i)], "id int, n int"), i)
        assert sorted(map(tuple, writers.upserted(spark, path, ["id"]).collect())) == [*((k, k) for k in range(i + 1)), (99, i)]
    assert spark.read.parquet(f"{path}/kind=merged/at=5").count() == 7 and not (tmp_path / "t" / "kind=batch" / "at=1").exists()


def test_dimension_job(spark, tmp_path):
    config = spark.createDataFrame([("user_info", None, "dim_user", "dim", "id,name", None, "SALT_BUCKETS=4"), ("base_x", None, "dim_x", "dim", "code,v", "code", None)], schemas.CONFIG)
    each = jobs.dimensions(lambda: config, str(tmp_path))
    each(changes(spark, ("user_info", "insert", "1", {"id": "1", "name": "a", "secret": "s"}, None), ("user_info", "update", "2", {"id": "1", "name": "b"}, None), ("base_x", "insert", "1", {"code": "c", "v": None}, None), ("other", "insert", "1", {"id": "9"}, None)), 0)
    each(changes(spark, ("user_info", "insert", "3", {"id": "2", "name": "z"}, None), ("user_info", "delete", "4", {"id": "1", "name": "gone"}, None), ("base_x", "insert", "5", {"v": "no key"}, None)), 1)
    user, x = (r.asDict() for r in config.collect())
    assert sorted(map(tuple, jobs.dimension(spark, str(tmp_path), user).collect())) == [("1", "b"), ("2", "z")]
    assert [tuple(r) for r in jobs.dimension(spark, str(tmp_path), x).collect()] == [("c", None)]


def test_dimension_tables_on_demand(spark):
    name = writers.ensure_dimension(spark, {"sink_table": "dim_on_demand", "sink_columns": "name,age", "sink_pk": None, "sink_extend": "SALT_BUCKETS=4"})
    assert spark.table(name).columns == ["id", "name", "age"] and readers.row_query(spark, name, id="1").count() == 0
    spark.sql(f"drop table {name}")
    for bad in ({"sink_table": "x; drop table y", "sink_columns": "a"}, {"sink_table": "x", "sink_columns": "a` int, `b"}):
        with pytest.raises(ValueError, match="plain name"):
            writers.ensure_dimension(spark, bad)


def test_log_split_parses_each_value_once(spark):
    """Nothing that was parsed is named in a filter below, where Spark would parse it anew; values that hold no object go."""
    values = spark.createDataFrame([('{"page":{"a":1},"ts":2}',), ("no object",), ("[1]",), (None,)], "value string").repartition(1)
    split = etl.tagged_split(etl.parsed(values))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert [tuple(r) for r in split.collect()] == [("page", '{"page":{"a":1},"ts":2}')]


def _shop(spark):
    """Two lines of one order, one of them a day before its payment and with a source that has no name; two coupons of the other."""
    line = {"order_id": "7", "sku_id": "5", "sku_num": "2", "order_price": "3.5", "split_total_amount": "7.0"}
    rows = [("order_info", "insert", "1", {"id": "7", "user_id": "8", "province_id": "9"}, None)]
    rows += [("order_detail", "insert", "1", {**line, "id": "a", "create_time": "2024-01-02 00:00:00", "source_type": "2401"}, None), ("order_detail", "insert", "1", {**line, "id": "b", "create_time": "2024-01-01 00:00:00", "source_type": "none"}, None)]
    rows += [("order_detail_coupon", "insert", "1", {"order_detail_id": "a", "coupon_id": c}, None) for c in "12"]
    return changes(spark, *rows)


def test_lines_without_a_source_are_not_shuffled(spark):
    rows = dwd.order_detail(_shop(spark), spark.createDataFrame(DIC, schemas.DIC))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Join Inner, (d_order_id")  # further down, so before the join with orders
    assert sorted((r["id"], r["coupon_id"], r["split_original_amount"]) for r in rows.collect()) == [("a", "1", "7.0000"), ("a", "2", "7.0000")]


def test_sums_count_a_line_with_two_coupons_once(spark):
    rows = dws.order_amounts(dwd.order_lines(_shop(spark), spark.createDataFrame(DIC, schemas.DIC))).withColumn("row_time", F.to_timestamp("create_time"))
    assert [(r["sku_id"], float(r["original_amount"]), float(r["order_amount"])) for r in dws.sku_sums(rows).collect()] == [("5", 7.0, 7.0)]


def test_only_paid_lines_are_widened(spark):
    paid = changes(spark, ("payment_info", "insert", "1704154500", {"user_id": "8", "order_id": "7", "payment_type": "1101"}, None))
    for later, want in ((0, ["a"]), (1, [])):
        pays = readers.with_event_time(paid.withColumn("ts", (F.col("ts").cast("long") + later).cast("string")))
        lines = dwd.paid_lines(_shop(spark), pays)
        assert [r["d_id"] for r in lines.collect()] == want
