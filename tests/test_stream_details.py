"""Detail tables on streams: corrected order lines, the payment interval join, and rows that come too late."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.windows import tumble
from tidemark.plans import dwd
from tidemark.sinks.store import KeyedStore
from tidemark.sources import readers
from tidemark.streaming import changelog, details, jobs, lookups

DIC = [("2401", "search"), ("1101", "card")]
T0 = 1_704_110_400


def add(folder, n, *records):
    folder.mkdir(exist_ok=True)
    part = folder.parent / "part"
    part.write_text("".join(json.dumps(r) + "\n" for r in records))
    os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    part.rename(folder / f"{n:03d}.txt")


def change(table, at, kind="insert", old=None, **data):
    return {"database": "shop", "table": table, "type": kind, "ts": str(T0 + at), "data": data, "old": old}


def line(k, at, order="o1", source="2401"):
    return change("order_detail", at, id=k, order_id=order, sku_id="s", sku_num="2", order_price="1.5", source_type=source, create_time="2024-01-01 12:00:00", split_total_amount="3.0")


def stream(spark, folder, delay="10 seconds"):
    return readers.with_event_time(readers.changes(readers.file_values(spark, str(folder), 100)), delay=delay)


def test_order_lines_are_corrected_and_end_as_the_batch_table(spark, tmp_path):
    folder, store = tmp_path / "in", KeyedStore(str(tmp_path / "table"), ["id"], every=2)
    dic = lookups.Aged(lambda s: s.createDataFrame(DIC, schemas.DIC))
    marks = []

    def write(batch, batch_id):
        batch = batch.persist()
        marks.extend(sorted((r["mark"], r["id"], r["activity_id"], r["coupon_id"]) for r in batch.collect()))
        store.write(changelog.upserts(batch), batch_id)
        batch.unpersist()

    def go():
        changed = details.order_detail(stream(spark, folder), "30 seconds")
        each = jobs.with_lookups(lambda batch, found: details.order_detail_rows(batch, found["base_dic"]), {"base_dic": dic}, write)
        jobs.run(changed, str(tmp_path / "c"), each=each).awaitTermination(180)

    records = [[change("order_info", 0, id="o1", user_id="u", province_id="p"), line("1", 1), line("2", 1), line("3", 1, source="missing"), change("order_detail_coupon", 1, order_detail_id="2", coupon_id="c")]]
    records.append([change("order_detail_activity", 5, order_detail_id="1", activity_id="a", activity_rule_id="r"), line("4", 8)])
    for n, part in enumerate(records):
        add(folder, n, *part)
        go()
    assert marks == [("insert", "1", None, None), ("insert", "2", None, "c"), ("insert", "1", "a", None), ("insert", "4", None, None), ("retract", "1", None, None)]
    values = spark.createDataFrame([(json.dumps(r),) for part in records for r in part], "value string")
    want = dwd.order_detail(readers.changes(values), dic.current(spark))
    assert sorted(map(repr, store.read(spark).select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.count() == 3


def test_payments_meet_their_order_lines_on_streams(spark, tmp_path):
    lines, pays = tmp_path / "lines", tmp_path / "pays"
    detail = lambda k, at: {n: None for n in schemas.ORDER_DETAIL.names} | {"id": k, "order_id": f"o{k}", "ts": str(T0 + at)}
    pay = lambda k, at: change("payment_info", at, user_id="u", order_id=f"o{k}", payment_type="1101", callback_time="x")
    add(lines, 0, *(detail(str(k), 0) for k in range(6)), detail("end", 90_000))
    add(pays, 0, pay("0", 0), pay("1", 900), pay("2", 901), pay("3", -5), pay("4", -6), pay("end", 90_000))
    rows = lines and readers.file_values(spark, str(lines)).select(F.from_json("value", schemas.ORDER_DETAIL).alias("r")).select("r.*")
    found = dwd.pay_detail(stream(spark, pays, "0 seconds"), readers.with_event_time(rows, delay="0 seconds"), spark.createDataFrame(DIC, schemas.DIC))
    jobs.run(found, str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(120)
    got = sorted(r["order_detail_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["0", "1", "3", "end"]  # 15 minutes before to 5 seconds after the payment, both ends in


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    at, folder, out = datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "out")
    seconds = [[0, 9, 25], [14, 8, 22], [300]]  # 25 less 3 seconds is past the ends of the windows of 14 and 8
    for part in seconds:
        spark.createDataFrame([(at + timedelta(seconds=s),) for s in part], "t timestamp").coalesce(1).write.mode("append").parquet(folder)
        rows = readers.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=10).withWatermark("t", "3 seconds")
        jobs.run(tumble(rows, "t", [], n=F.count("*")), str(tmp_path / "c"), out).awaitTermination(120)  # each time a restart
    got = sorted((r["stt"][-8:], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [("00:00:00", 2), ("00:00:20", 2)]
