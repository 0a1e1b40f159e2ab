"""A table's snapshot and log as a stream, and a table at a stream's end: nothing lost and nothing twice."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sinks import database as sinks
from tidemark.sources import database as sources
from tidemark.streaming import connected

SQLITE = "sqlite3:connect"


class Shop:
    """A table with a log that is written in the same transaction."""

    def __init__(self, path):
        self.path = str(path)
        self.own = sqlite3.connect(self.path)
        self.own.execute("create table config (id integer primary key, name text, v text)")
        self.own.execute("create table config_log (seq integer primary key, op text, before_row text, after_row text, ts_ms integer)")
        self.seq, self.rows = 0, {}

    def put(self, key, name, v="x"):
        before, after = self.rows.get(key), {"id": key, "name": name, "v": v}
        self.rows[key] = after
        self._log("u" if before else "c", before, after, "insert or replace into config values (?, ?, ?)", (key, name, v))

    def drop(self, key):
        if key in self.rows:
            self._log("d", self.rows.pop(key), None, "delete from config where id = ?", (key,))

    def _log(self, op, before, after, sql, values):
        self.seq += 1
        text = lambda r: None if r is None else json.dumps(r)
        self.own.execute(sql, values)
        self.own.execute("insert into config_log values (?, ?, ?, ?, ?)", (self.seq, op, text(before), text(after), self.seq * 10))
        self.own.commit()

    def some(self, rng, n):
        for _ in range(n):
            key = rng.randrange(40)
            self.drop(key) if rng.random() < 0.3 else self.put(key, f"n{rng.randrange(1000)}")


def options(shop):
    return {"connect": SQLITE, "arguments": json.dumps([shop.path, 60]), "table": "config", "log": "config_log", "key": "id", "partitions": "3", "entries": "7"}


def test_snapshot_is_of_one_moment_whatever_happens_after(tmp_path):
    rng, shop = random.Random(3), Shop(tmp_path / "a.db")
    for n in (0, 60):
        shop.some(rng, n)
        reader = sources._Reader(options(shop))
        start, end, then = reader.initialOffset(), reader.latestOffset(), dict(shop.rows)
        shop.some(rng, 30)  # before the tasks read
        rows = []
        for part in reader.partitions(start, end):
            rows += [json.loads(v)["after"] for (v,) in reader.read(part)]
            shop.some(rng, 10)  # and while they do
        assert sorted(r["id"] for r in rows) == sorted(then) and {r["id"]: r for r in rows} == then
        after = reader.latestOffset()
        changes = [json.loads(v) for part in reader.partitions(end, after) for (v,) in reader.read(part)]
        assert [c["seq"] for c in changes] == list(range(max(end["seq"], 0) + 1, shop.seq + 1))
        for c in changes:
            then.pop((c["before"] or c["after"])["id"], None)
            then |= {c["after"]["id"]: c["after"]} if c["after"] else {}
        assert then == shop.rows
    with pytest.raises(ValueError, match="plain name"):
        sources._Reader(options(shop) | {"table": "x; drop table y"})


def test_stream_of_a_table_over_restarts(spark, tmp_path):
    rng, shop = random.Random(4), Shop(tmp_path / "a.db")
    shop.some(rng, 50)

    def go():
        stream = sources.table_changes(spark, SQLITE, [shop.path, 60], "config", "config_log", "id", partitions="3")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return [json.loads(r[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    first = go()
    assert {e["op"] for e in first} == {"r"} and {e["after"]["id"]: e["after"] for e in first} == shop.rows
    seen = shop.seq
    shop.some(rng, 40)
    events = go()
    assert sorted(e["seq"] for e in events if e["op"] != "r") == list(range(seen + 1, shop.seq + 1)) and len([e for e in events if e["op"] == "r"]) == len(first)
    assert len(go()) == len(events)
    parsed = spark.createDataFrame([(json.dumps({"op": "u", "ts_ms": 3, "before": None, "after": {"source_table": "t", "sink_type": "dim"}}),)], "value string")
    assert connected.config_changes(parsed).first()["source_table"] == "t"


def test_rows_reach_a_table_once(spark, tmp_path):
    path = str(tmp_path / "sink.db")
    arguments = [path, 60]
    sinks.create_tables(SQLITE, arguments, "visits", {"stt": "text", "uv": "integer"})
    folder = str(tmp_path / "in")
    frame = spark.range(0, 2_000, 1, 4).select(F.col("id").alias("uv"), F.lit("more").alias("more"), F.col("id").cast("string").alias("stt"))
    frame.write.parquet(folder)
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(folder)

    def read(sql="select stt, uv from visits"):
        own = sqlite3.connect(path)
        try:
            return sorted(own.execute(sql).fetchall())
        finally:
            own.close()

    flag = tmp_path / "fail"
    flag.touch()

    @F.udf("long")
    def breaks(n):
        if n == 1_500 and flag.exists():
            raise ValueError("lost")
        return n

    def go():
        sinks.write_table(stream().withColumn("uv", breaks("uv")), str(tmp_path / "c"), SQLITE, arguments, "visits", ["stt", "uv"], "w1", rows=64).awaitTermination(120)

    with pytest.raises(Exception, match="lost"):
        go()
    flag.unlink()
    assert len(read()) in (0, 1_000)  # whole batches alone
    go()
    want = sorted((str(k), k) for k in range(2_000))
    assert read() == want and read("select * from visits_staged") == []
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the query had stopped between the table's commit and its own
    (tmp_path / "c" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert read() == want and read("select writer, epoch from visits_epochs") == [("w1", int(last.name))]
    with pytest.raises(Exception, match="no such columns"):
        sinks.write_table(stream(), str(tmp_path / "c2"), SQLITE, arguments, "visits", ["stt", "missing"], "w2").awaitTermination(60)
