"""Streams that follow what changes while they run, over batches and restarts: routing, corrected joins, dimensions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import routing
from tidemark.plans import dws
from tidemark.sinks.store import KeyedStore
from tidemark.sources import readers
from tidemark.streaming import changelog, connected, jobs, lookups


class Feed:
    """A folder of text files; each call adds one, newer than those before."""

    def __init__(self, folder):
        self.folder, self.n = folder, 0
        folder.mkdir(parents=True)

    def add(self, *records):
        part = self.folder.parent / f"{self.folder.name}.part"
        part.write_text("".join(json.dumps(r) + "\n" for r in records))
        self.n += 1
        os.utime(part, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        part.rename(self.folder / f"{self.n:05d}.txt")

    def values(self, spark):
        return readers.file_values(spark, str(self.folder), 100)


def row(source, sink, columns, kind="dim", pk=None, source_type="ALL"):
    return dict(zip(schemas.CONFIG.names, (source, source_type, sink, kind, columns, pk, None)))


def config(op, ts, before, after):
    return {"before": before, "after": after, "op": op, "ts_ms": ts, "source": {"more": 1}}


def change(table, ts, kind="insert", **data):
    return {"database": "shop", "table": table, "type": kind, "ts": str(ts), "data": data}


def routes(spark, feeds, tmp_path, **how):
    """Run until the feeds are read, from the checkpoint on where there is one; all rows so far."""
    changes, rows = feeds
    found = connected.routed(readers.changes(changes.values(spark)), connected.config_changes(rows.values(spark)), **how)
    jobs.run(found, str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(180)
    return sorted((r["sink_table"], sorted(r["data"].items())) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_routing_follows_the_configuration_over_restarts(spark, tmp_path):
    feeds = changes, rows = Feed(tmp_path / "changes"), Feed(tmp_path / "config")
    pre = spark.createDataFrame([tuple(row("base_x", "dim_x", "code", pk="code").values()), tuple(row("t", "dwd_t", "id", "dwd").values())], schemas.CONFIG)
    user = row("user_info", "dim_user", "id,name")
    rows.add(config("r", 1, None, user), config("c", 2, None, row("facts", "dwd_f", "id", "dwd")))
    changes.add(change("user_info", 1, id="1", name="n", age="9"), change("sku_info", 1, id="2", price="5"), change("base_x", 1, code="c", v="w"), change("facts", 1, id="3"), {"table": "user_info", "type": "insert", "ts": "1", "data": None}, "no object")
    got = routes(spark, feeds, tmp_path, preloaded=pre)
    assert got == [("dim_user", [("id", "1"), ("name", "n")]), ("dim_x", [("code", "c")])]
    sku = row("sku_info", "dim_sku", "id")
    rows.add(config("c", 3, None, sku), config("u", 3, sku, row("sku_info", "dim_sku", "id,price")), config("u", 5, user, row("user_info", "dim_user", "id,name,age")))
    changes.add(change("user_info", 2, "update", id="1", name="m", age="10"), change("sku_info", 2, id="4", price="6"))
    got = routes(spark, feeds, tmp_path, preloaded=pre)
    assert got == [("dim_sku", [("id", "4"), ("price", "6")]), ("dim_user", [("age", "10"), ("id", "1"), ("name", "m")]), ("dim_user", [("id", "1"), ("name", "n")]), ("dim_x", [("code", "c")])]
    rows.add(config("d", 9, row("user_info", "dim_user", "id,name,age"), None), config("u", 4, user, user), config("d", 9, row("base_x", "dim_x", "code", pk="code"), None))  # the second is late
    changes.add(change("user_info", 3, id="7", name="gone", age="1"), change("base_x", 3, code="gone"), change("sku_info", 3, id="8", price="1"))
    assert routes(spark, feeds, tmp_path, preloaded=pre) == sorted([*got, ("dim_sku", [("id", "8"), ("price", "1")])])
    changes.add(change("sku_info", 4, id="9", price="2"), change("user_info", 4, id="9", name="still gone"))  # restarted: known from the state alone
    last = routes(spark, feeds, tmp_path, preloaded=pre)
    assert len(last) == len(got) + 2 and ("dim_sku", [("id", "9"), ("price", "2")]) in last


def test_routing_of_facts_equals_the_batch_form(spark, tmp_path):
    feeds = changes, rows = Feed(tmp_path / "changes"), Feed(tmp_path / "config")
    wanted = [row("order_info", "dwd_orders", "id,status", "dwd", source_type="insert"), row("order_info", "dwd_moves", "id", "dwd", source_type="update"), row("user_info", "dim_user", "id")]
    rows.add(*(config("r", k, None, r) for k, r in enumerate(wanted)))
    rng = random.Random(2)
    records = [change(rng.choice(["order_info", "user_info", "x"]), k, rng.choice(["insert", "update", "delete"]), id=str(k), status="s", more="m") for k in range(200)]
    changes.add(*records)
    values = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    batch = routing.route_facts(readers.changes(values), spark.createDataFrame([tuple(r.values()) for r in wanted if r["sink_type"] == "dwd"], schemas.CONFIG))
    want = sorted((r["sink_table"], sorted(r["data"].items())) for r in batch.collect())
    assert routes(spark, feeds, tmp_path, sink_type="dwd", by_type=True, deals=3) == want and len(want) > 20


LINES, SIDE = "id string, op string, ts long, sku string, kind string", "id string, op string, ts long, {0}_id string, kind string"


def typed(feed, spark, schema):
    return feed.values(spark).select(F.from_json("value", schema).alias("r")).select("r.*")


def test_left_join_is_given_at_once_and_corrected(spark, tmp_path):
    lines, acts, coupons = (Feed(tmp_path / n) for n in ("lines", "acts", "coupons"))
    marks = KeyedStore(str(tmp_path / "table"), ["id"], every=3)
    said = []

    def each(batch, batch_id):
        batch.persist()
        said.append(sorted((r["mark"], r["id"], r["sku"], r["act_id"], r["coupon_id"]) for r in batch.collect()))
        said[-1].append(sorted((r["key"], r["value"] is not None) for r in changelog.topic_rows(batch, "id").collect()))
        marks.write(changelog.upserts(batch), batch_id)
        batch.unpersist()

    def go():
        joined = changelog.left_join(typed(lines, spark, LINES), {"act": typed(acts, spark, SIDE.format("act")), "coupon": typed(coupons, spark, SIDE.format("coupon"))}, "id")
        assert joined.columns == ["mark", "id", "sku", "kind", "act_id", "act_kind", "coupon_id", "coupon_kind"]
        said.clear()
        jobs.run(joined, str(tmp_path / "c"), each=each).awaitTermination(180)
        table = marks.read(spark)
        return sorted(((r["id"], r["sku"], r["act_id"], r["coupon_id"]) for r in table.collect()), key=repr)

    line = lambda i, ts, op="insert", sku="s": {"id": i, "op": op, "ts": ts, "sku": sku, "kind": "k"}
    side = lambda n, i, ts, v, op="insert": {"id": i, "op": op, "ts": ts, f"{n}_id": v, "kind": "k"}
    lines.add(line("1", 1), line("2", 1), line(None, 1))
    acts.add(side("act", "2", 1, "a2"))
    coupons.add(side("coupon", "3", 1, "c3"))
    assert go() == [("1", "s", None, None), ("2", "s", "a2", None)]
    assert said[0][:-1] == [("insert", "1", "s", None, None), ("insert", "2", "s", "a2", None)]
    acts.add(side("act", "1", 2, "a1"))  # after a restart
    lines.add(line("3", 2))
    assert go() == [("1", "s", "a1", None), ("2", "s", "a2", None), ("3", "s", None, "c3")]
    assert said[0] == [("insert", "1", "s", "a1", None), ("insert", "3", "s", None, "c3"), ("retract", "1", "s", None, None), [("1", False), ("1", True), ("3", True)]]
    lines.add(line("2", 3, "delete"), line("3", 3, "update", "new"))
    acts.add(side("act", "1", 3, None, "delete"))
    assert go() == [("1", "s", None, None), ("3", "new", None, "c3")] and ("delete", "2", "s", "a2", None) in said[0]
    lines.add(line("2", 4))  # its side is still known
    assert go() == [("1", "s", None, None), ("2", "s", "a2", None), ("3", "new", None, "c3")]


def test_changelog_ends_as_the_batch_join(spark, tmp_path):
    rng, state = random.Random(6), {"l": {}, "r": {}}
    feeds = {"l": Feed(tmp_path / "l"), "r": Feed(tmp_path / "r")}
    store = KeyedStore(str(tmp_path / "table"), ["id"], every=2)
    ts = 0
    for _ in range(5):
        for n, feed in feeds.items():
            records = []
            for _ in range(60):
                ts += 1
                key, op = str(rng.randrange(40)), rng.choice(["insert", "update", "delete"])
                records.append({"id": key, "op": op, "ts": ts, f"{n}v": ts})
                state[n] = {k: v for k, v in state[n].items() if k != key} if op == "delete" else {**state[n], key: ts}
            feed.add(*records)
        sides = [typed(feeds[n], spark, f"id string, op string, ts long, {n}v long") for n in "lr"]
        jobs.run(changelog.left_join(sides[0], {"r": sides[1]}, "id"), str(tmp_path / "c"), each=lambda b, i: store.write(changelog.upserts(b), i)).awaitTermination(180)
        want = sorted((k, v, state["r"].get(k, -1)) for k, v in state["l"].items())
        assert sorted(map(tuple, store.read(spark).na.fill(-1).select("id", "lv", "rv").collect())) == want


def test_store_merges_removes_and_holds_versions(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "t"), ["id"], ["n"], every=3, keep=2)
    assert store.read(spark) is None
    frame = lambda *rows: spark.createDataFrame(rows, "id int, n int, __deleted boolean")
    for i in range(10):
        store.write(frame((i, i, None), (99, i, False), (i - 1, i, True)), i)
        if i in (2, 4):
            store.write(frame((i, i, None), (99, i, False), (i - 1, i, True)), i)  # replayed
        assert sorted(map(tuple, store.read(spark).collect())) == [(i, i), (99, i)]
    folders = {k: sorted(p.name for p in (tmp_path / "t" / f"kind={k}").iterdir()) for k in ("batch", "merged")}
    assert folders["merged"] == ["at=8"] and folders["batch"] == ["at=9"]  # of versions 8 and 9
    held = store.version(spark)
    store.write(spark.createDataFrame([(5, 1, "wide")], "id int, n int, more string"), 10)
    assert sorted(map(tuple, store.read(spark, held).collect())) == [(9, 9), (99, 9)]
    assert sorted(map(tuple, store.read(spark).collect())) == [(5, 1, "wide"), (9, 9, None), (99, 9, None)]
    store.write(frame().select("id", "n"), 11)
    assert store.read(spark).count() == 3


def test_a_renamed_product_shows_in_the_next_batch(spark, tmp_path):
    """Dimensions from a connected configuration, read by version in another stream's batches."""
    changes, rows, sums = (Feed(tmp_path / n) for n in ("changes", "config", "sums"))
    path = str(tmp_path / "dims")
    tables = {"sku_info": "id,sku_name,spu_id,tm_id,category3_id", "spu_info": "id,spu_name", "base_trademark": "id,tm_name", "base_category3": "id,name,category2_id", "base_category2": "id,name,category1_id", "base_category1": "id,name"}
    found = {t: jobs.dimension_lookup(path, f"dim_{t}", *c.split(",")) for t, c in tables.items()}
    schema = "stt string, edt string, sku_id string, " + ", ".join(f"{n} decimal(16,2)" for n in dws.AMOUNTS)
    seen = []

    def go():
        routed = connected.routed(readers.changes(changes.values(spark)), connected.config_changes(rows.values(spark)))
        jobs.run(routed, str(tmp_path / "cd"), each=jobs.connected_dimensions(path)).awaitTermination(180)

    def keep(batch, batch_id):
        seen.append(sorted((r["sku_id"], r["sku_name"], r["trademark_name"]) for r in batch.collect()))

    sums.add({"stt": "a", "edt": "b", "sku_id": "1"})
    query = jobs.run(typed(sums, spark, schema), str(tmp_path / "cs"), each=jobs.with_lookups(dws.sku_named, found, keep), trigger={"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        assert seen == [[("1", None, None)]]  # no dimension yet
        rows.add(*(config("r", 1, None, row(t, f"dim_{t}", c)) for t, c in tables.items()))
        changes.add(change("sku_info", 1, id="1", sku_name="old", tm_id="7", secret="s"), change("base_trademark", 1, id="7", tm_name="mark"))
        go()
        sums.add({"stt": "b", "edt": "c", "sku_id": "1"})
        query.processAllAvailable()
        changes.add(change("sku_info", 2, "update", id="1", sku_name="new", tm_id="7"), change("base_trademark", 2, "delete", id="7", tm_name="gone"))
        go()
        sums.add({"stt": "c", "edt": "d", "sku_id": "1"})
        query.processAllAvailable()
        assert seen[1:] == [[("1", "old", "mark")], [("1", "new", "mark")]]
    finally:
        query.stop()


def test_dictionaries_are_read_anew_after_their_age(spark):
    now, reads = [0.0], []

    def read(session):
        reads.append(now[0])
        return session.createDataFrame([(str(len(reads)),)], "dic_name string")

    dic = lookups.Aged(read, 60, lambda: now[0])
    assert [dic.current(spark).first()[0] for now[0] in (0.0, 59.0, 60.0, 100.0, 120.0)] == ["1", "1", "2", "2", "3"] and reads == [0.0, 60.0, 120.0]


@pytest.mark.parametrize("wide", [False, True])
def test_orders_of_a_stream_are_counted_without_a_set(spark, tmp_path, wide):
    from datetime import datetime, timedelta

    rng, at = random.Random(9), datetime(2024, 1, 1)
    rows = [(at + timedelta(seconds=rng.randrange(60)), rng.randrange(3), None if rng.random() < 0.1 else rng.randrange(25), rng.randrange(-5, 9)) for _ in range(400)]
    schema = "row_time timestamp, province_id long, order_id long, order_amount decimal(16,2)"
    from decimal import Decimal

    frame = spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], schema)
    folder = str(tmp_path / "in")
    frame.repartition(4 if wide else 1).write.parquet(folder)
    spark.createDataFrame([(at + timedelta(days=9), 9, 9, Decimal(1))], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = readers.file_stream(spark, folder, frame.schema, files_per_batch=10).withWatermark("row_time", "3 seconds")
    jobs.run(dws.province_sums(stream), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, dws.province_sums(frame).collect())) and len(got) == 18
    assert "collect_set" not in dws.province_sums(stream)._jdf.queryExecution().analyzed().toString()
