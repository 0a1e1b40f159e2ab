"""Readers, routing and writers that no query reaches."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar
from tidemark.operators import routing
from tidemark.plans import serving
from tidemark.sinks import writers
from tidemark.sources import readers
from tidemark.streaming import jobs

CONFIG = [("user_info", "ALL", "dim_user", "dim", "id,name", "id", None), ("order_info", "insert", "dwd_orders", "dwd", "id,status", None, None), ("order_info", "update", "dwd_changes", "dwd", "id", None, None)]


def test_kafka_options_read_committed_records_only():
    options = readers.kafka_options("h:9092", "topic_db", "group", "earliest")
    assert options["kafka.isolation.level"] == "read_committed" and options["subscribe"] == "topic_db" and options["startingOffsets"] == "earliest" and options["kafka.group.id"] == "group"


def test_config_rows_before_and_after_changes(spark):
    table = spark.createDataFrame(CONFIG, schemas.CONFIG)
    assert {r["sink_table"] for r in readers.config_rows(table, "dwd").collect()} == {"dwd_orders", "dwd_changes"}
    wide = ("user_info", "ALL", "dim_user", "dim", "id,name,age", "id", None)
    rows = [(None, CONFIG[0], "r", 1), (CONFIG[0], wide, "u", 2), (None, ("sku", "ALL", "dim_sku", "dim", "id", None, None), "c", 1), (("sku", "ALL", "dim_sku", "dim", "id", None, None), None, "d", 3)]
    now = routing.current_config(spark.createDataFrame(rows, schemas.CONFIG_CHANGE), "dim", ("source_table",)).collect()
    assert [(r["sink_table"], r["sink_columns"]) for r in now] == [("dim_user", "id,name,age")]


def test_route_job_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    change = lambda table, kind, **data: json.dumps({"database": "d", "table": table, "type": kind, "ts": "5", "data": data})
    (tmp_path / "in" / "a.txt").write_text("\n".join([change("user_info", "insert", id="1", name="n", secret="s"), change("order_info", "insert", id="2", status="x", more="y"), change("order_info", "update", id="3", status="z"), change("other", "insert", id="4"), "broken"]))
    config = lambda kind: lambda: readers.config_rows(spark.createDataFrame(CONFIG, schemas.CONFIG), kind)
    for kind, facts in (("dim", False), ("dwd", True)):
        changes = readers.changes(readers.file_values(spark, str(tmp_path / "in")))
        jobs.run(changes, str(tmp_path / f"c_{kind}"), each=jobs.route(config(kind), str(tmp_path / kind), facts)).awaitTermination(60)
    read = lambda kind: sorted((r["sink_table"], dict(r["data"])) for r in spark.read.parquet(str(tmp_path / kind)).collect())
    assert read("dim") == [("dim_user", {"id": "1", "name": "n"})]
    assert read("dwd") == [("dwd_changes", {"id": "3"}), ("dwd_orders", {"id": "2", "status": "x"})]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("t1", 1, "a"), ("t2", 2, None)], "sink_table string, n int, s string")
    writers.by_sink_table(rows, str(tmp_path / "topics"))
    assert json.loads(next((tmp_path / "topics" / "sink_table=t1").glob("*.json")).read_text()) == {"n": 1, "s": "a"}
    writers.append_rows(rows, ["s", "n"], str(tmp_path / "sink"))
    writers.append_rows(rows, ["s", "n"], str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).columns == ["s", "n"] and spark.read.parquet(str(tmp_path / "sink")).count() == 4
    once = writers.once_per_batch(str(tmp_path / "once"))
    once(rows, 0), once(rows, 0), once(rows, 1)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 4
    values = writers.kafka_values(rows, "topic", "n").collect()
    assert {(r["topic"], r["key"]) for r in values} == {("topic", "1"), ("topic", "2")} and json.loads(values[0]["value"])["sink_table"] == "t1"


def test_days_and_answers(spark):
    today = int(datetime.now(timezone.utc).strftime("%Y%m%d"))
    assert serving.day_or_today(0) == today and serving.day_or_today(20240102) == 20240102
    assert spark.range(1).select(scalar.today_number().alias("n")).first()["n"] in (today, int(datetime.now(timezone.utc).strftime("%Y%m%d")))
    now = spark.createDataFrame([("web", 3), ("app", 5)], "ch string, uv long").withColumn("stt", F.current_timestamp().cast("timestamp_ntz"))
    assert json.loads(serving.channel_visitors_json(now).first()["value"]) == {"status": 0, "data": {"categories": ["app", "web"], "series": [{"name": "渠道", "data": [5, 3]}]}}
    assert json.loads(serving.gmv_json(now, amount="uv").first()["value"]) == {"status": 0, "data": 8} and serving.gmv_json(now, 20010101, amount="uv").first()["value"] == '{"status":0,"data":0}'
