"""Streams give what their batch forms give, for input in order."""

import json
import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import etl, joins, state
from tidemark.operators.windows import page_metrics
from tidemark.plans import dws
from tidemark.schemas import ORDER_DETAIL
from tidemark.sources import readers
from tidemark.sources.readers import file_stream, file_values
from tidemark.streaming import jobs, processors, summaries

SCHEMA = "event_id long, mid string, user_id string, page_id string, is_new string, row_time timestamp"
ORDER = ["row_time", "event_id"]


def day():
    return F.to_date("row_time")



@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng, at, rows = random.Random(5), datetime(2024, 1, 1), []
    for i in range(120):
        at += timedelta(hours=rng.choice([1, 5, 30, 60]))
        key = f"m{rng.randrange(4)}"
        rows.append((i, key, key, rng.choice(["home", "good_detail"]), rng.choice("01"), at))
    df = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path_factory.mktemp("events"))
    for k in range(2):
        df.where(f"event_id div 60 = {k}").coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def streamed(spark, events, tmp_path, transform):
    source = file_stream(spark, events[1], events[0].schema, files_per_batch=10).withWatermark("row_time", "3 seconds")
    jobs.run(transform(source), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def pairs(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_repair_is_new(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, processors.repair_is_new)
    assert pairs(got, "event_id", "is_new") == pairs(state.repair_is_new(events[0], "mid", day(), ORDER), "event_id", "is_new")


def test_logins(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, processors.login_metrics)
    want = state.login_metrics(events[0], "user_id", day(), ORDER).where("uu > 0")
    assert pairs(got, "row_time", "uu", "back") == pairs(want, "row_time", "uu", "back")


def test_daily_users_and_visitors(spark, events, tmp_path):
    want = state.first_of_day(events[0], ["mid"], day(), ORDER)
    assert pairs(streamed(spark, events, tmp_path / "a", processors.daily_users), "event_id") == pairs(want.where("uv = 1"), "event_id")
    assert pairs(streamed(spark, events, tmp_path / "b", processors.daily_visitors), "event_id", "uv") == pairs(want, "event_id", "uv")


def write_values(folder, *parts):
    folder.mkdir()
    for k, part in enumerate(parts):
        (folder / f"{k}.txt").write_text("".join((v if isinstance(v, str) else json.dumps(v)) + "\n" for v in part))
        os.utime(folder / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    return str(folder)


def record(mid, at, page="home", is_new="1", **more):
    return {"common": {"mid": mid, "uid": mid.replace("m", "u"), "vc": "v1", "ch": "web" if mid < "m2" else "app", "ar": "1", "is_new": is_new, "os": {"name": "x"}}, "page": {"page_id": page, "during_time": 7, "more": [1]}, "ts": int(at.timestamp() * 1000), **more}


T0 = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)


def test_log_job_repairs_before_it_splits(spark, tmp_path):
    later = T0 + timedelta(days=2)
    first = [record("m1", T0, displays=[{"x": "1"}, {"x": 2}]), record("m2", T0, is_new="0"), "broken", "[1]"]
    second = [record("m1", later, actions=[{"a": 1}], err={"e": 1}), record("m2", later, is_new="1", start={"s": 1}), {"common": {"mid": "m3"}, "page": {"page_id": "timeless"}}, {"common": {"is_new": "1"}, "ts": 5, "tab": "a\tb"}, {"page": {}}]
    source = write_values(tmp_path / "in", first)

    def go():
        query = jobs.log_job(file_values(spark, source), str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination(120)
        return query

    go()
    write_values(tmp_path / "more", second)
    (tmp_path / "more" / "0.txt").rename(tmp_path / "in" / "1.txt")
    query = go()  # restarted: m1's first day comes from the checkpoint
    assert len(query.recentProgress) == 1 and query.recentProgress[0]["numInputRows"] == 5  # the source is read once
    read = lambda name: [json.loads(r["value"]) if name != "dirty_data" else r["value"] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("tag") == name).collect()]
    assert sorted(read("dirty_data")) == ["[1]", "broken"]
    pages = {(r["common"].get("mid"), r.get("ts")): r for r in read("page") if "common" in r}
    assert len(pages) == 5 and pages["m3", None]["page"]["page_id"] == "timeless" and pages[None, 5] == {"common": {"is_new": "1"}, "ts": 5, "tab": "a\tb"} and {"page": {}} in read("page")
    one, two = pages["m1", int(T0.timestamp() * 1000)], pages["m1", int(later.timestamp() * 1000)]
    assert one["common"]["is_new"] == "1" and two["common"]["is_new"] == "0" and one["common"]["os"] == {"name": "x"} and one["page"]["more"] == [1] and "displays" not in one and "err" not in two
    assert read("start") == [{"s": 1}] and read("err") == [{"e": 1}]
    assert sorted(int(r["display"]["x"]) for r in read("display")) == [1, 2] and read("action")[0]["common"]["is_new"] == "0"


END = [record("m9", T0 + timedelta(days=400)), record("m9", T0 + timedelta(days=400), page="list")]
END[1]["page"] |= {"last_page_id": "search", "item_type": "keyword", "item": "end"}


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    rng, at, rows = random.Random(8), T0, []
    for _ in range(90):
        at += timedelta(seconds=rng.choice([1, 3, 40, 3600 * 20, 3600 * 60]))
        page = rng.choice(["home", "good_detail", "cart", "list"])
        rows.append(record(f"m{rng.randrange(3)}", at, page))
        rows[-1]["page"] |= {"last_page_id": rng.choice([None, "login", "search", "home"]), "item_type": "keyword", "item": rng.choice(["red shoe", "shoe", None])}
    # The last file's records lie far behind all others, so that every window before them is closed.
    folder = write_values(tmp_path_factory.mktemp("logs") / "in", rows[:40], rows[40:], END)
    batch = readers.logs(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    flat = batch.select("common.*", "page.page_id", "page.last_page_id", "page.item", "page.item_type", "page.during_time", "row_time")
    return folder, batch, flat


def windowed(spark, folder, tmp_path, transform, name):
    jobs.run(transform(file_values(spark, folder)), str(tmp_path / name / "c"), str(tmp_path / name / "out")).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / name / "out"))
    return sorted((tuple(r) for r in got.drop("ts").collect()), key=repr)


def all_of(df):
    return sorted((tuple(r) for r in df.drop("ts").collect()), key=repr)


def test_summaries_of_logs(spark, logs, tmp_path):
    folder, batch, flat = logs
    text.register(spark)
    order = ["row_time"]
    views = page_metrics(state.first_of_day(flat, ["mid"], day(), order), F.col("last_page_id"), F.col("during_time"))
    assert windowed(spark, folder, tmp_path, summaries.page_view, "page_view") == all_of(dws.page_view(views))
    both = state.first_of_day(etl.home_and_detail(flat), ["mid", "page_id"], day(), order)
    both = both.withColumns({"home_uv": F.when(F.col("page_id") == "home", F.col("uv")).otherwise(0), "detail_uv": F.when(F.col("page_id") != "home", F.col("uv")).otherwise(0)})
    assert windowed(spark, folder, tmp_path, summaries.home_detail, "home_detail") == all_of(dws.home_detail(both))
    logins = state.login_metrics(etl.logins(flat), "uid", day(), order)
    assert windowed(spark, folder, tmp_path, summaries.user_login, "user_login") == all_of(dws.user_login(logins))
    words = etl.search_words(batch).select("row_time", F.explode(F.split("page.item", " ")).alias("keyword"))
    assert windowed(spark, folder, tmp_path, summaries.keyword, "keyword") == all_of(dws.keyword(words))


def order_line(k, at, order, sku, province, total, coupon=None):
    line = {n: None for n in ORDER_DETAIL.names} | {"id": k, "order_id": order, "sku_id": sku, "province_id": province, "split_original_amount": f"{total}.0000", "split_total_amount": f"{total}.5", "split_coupon_amount": coupon}
    return line | {"ts": str(int(at.timestamp()))}


def test_summaries_of_carts_and_orders(spark, tmp_path):
    rng, at, carts, lines = random.Random(4), T0, [], []
    for k in range(60):
        at += timedelta(seconds=rng.choice([1, 2, 5, 3600 * 30]))
        carts.append({"id": str(k), "user_id": f"u{rng.randrange(4)}", "ts": str(int(at.timestamp()))})
        lines.append(order_line(str(k), at, f"o{k // 3}", f"s{rng.randrange(3)}", str(rng.randrange(2)), rng.randrange(1, 90)))
        if k % 4 == 0:  # the same line again, with its coupon
            lines.append({**lines[-1], "split_coupon_amount": "2.5"})
    far = T0 + timedelta(days=900)
    cart_folder = write_values(tmp_path / "carts", carts[:30], carts[30:], [{"id": "z", "user_id": "z", "ts": str(int(far.timestamp()))}])
    line_folder = write_values(tmp_path / "lines", [*lines[:35], ""], lines[35:], [order_line("z", far, "z", "z", "z", 1)])
    rows = readers.with_event_time(spark.createDataFrame([(c["id"], c["user_id"], c["ts"]) for c in carts], "id string, user_id string, ts string"))
    assert windowed(spark, cart_folder, tmp_path, summaries.cart_users, "cart_users") == all_of(dws.cart_users(state.first_of_day(rows, ["user_id"], day(), ["row_time"]).where("uv = 1")))
    last = {x["id"]: x for x in lines}.values()
    details = readers.with_event_time(spark.createDataFrame([tuple(x[n] for n in ORDER_DETAIL.names) for x in last], ORDER_DETAIL))
    amounts = dws.order_amounts(details)
    named = lambda *names: spark.createDataFrame([("s0", "x", *["1"] * 9), ("s1", "y", *["1"] * 9), ("1", "p", *["1"] * 9)], "id string, name string, sku_name string, spu_id string, tm_id string, category3_id string, category2_id string, category1_id string, spu_name string, tm_name string, more string")
    dims = {n: named() for n in ("sku_info", "spu_info", "base_trademark", "base_category3", "base_category2", "base_category1")}
    assert windowed(spark, line_folder, tmp_path, lambda v: summaries.sku_order(v, dims), "sku") == all_of(dws.sku_order(amounts, dims))
    assert windowed(spark, line_folder, tmp_path, lambda v: summaries.province_order(v, named()), "province") == all_of(dws.province_order(amounts, named()))


def test_last_row_within_processing_time(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 2, 3), ("b", 1, 4)], "id string, row_ts long, n int").coalesce(1).write.parquet(folder)
    source = file_stream(spark, folder, spark.read.parquet(folder).schema)
    query = jobs.run(processors.last_within(source), str(tmp_path / "c"), str(tmp_path / "out"), trigger={"processingTime": "1 second"})
    rows = []
    for _ in range(90):
        time.sleep(1)
        if any(tmp_path.joinpath("out", "_spark_metadata").glob("[0-9]*")):
            rows = sorted(tuple(r) for r in spark.read.schema(source.schema).parquet(str(tmp_path / "out")).collect())
        if len(rows) == 2:
            break
    query.stop()
    assert rows == [("a", 3, 2), ("b", 1, 4)]


def test_stream_stream_joins(spark, tmp_path):
    at = lambda s: (T0 + timedelta(seconds=s)).replace(tzinfo=None)
    a = [("1", at(0)), ("2", at(1)), ("3", at(2)), ("z", at(90_000))]
    b = [("1", at(3)), ("2", at(40)), ("y", at(90_000))]
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, f"{name}_id string, {name}_time timestamp").coalesce(1).write.parquet(str(tmp_path / name))
        spark.createDataFrame([("end", at(200_000))], f"{name}_id string, {name}_time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    source = lambda n: file_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema).withWatermark(f"{n}_time", "1 second")
    for how, want in (("inner", [("1", "1"), ("end", "end")]), ("left", [("1", "1"), ("2", None), ("3", None), ("end", "end"), ("z", None)])):
        joined = joins.detail_join(source("a"), source("b"), F.col("a_id") == F.col("b_id"), how, ("a_time", "b_time"), "10 seconds")
        jobs.run(joined, str(tmp_path / how / "c"), str(tmp_path / how / "out")).awaitTermination(120)
        assert pairs(spark.read.parquet(str(tmp_path / how / "out")).na.fill("-"), "a_id", "b_id") == sorted((x, y or "-") for x, y in want)
