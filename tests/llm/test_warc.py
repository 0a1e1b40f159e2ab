"""The archive: exact records, urls with odd line ends, repeated rows, null ids, empty tables and damaged payloads."""

import base64
import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, sha256 string, record_type string"
ROWS = [
    (1, "http://a", "<p>é"), (2, None, "<p>é"), (3, "http://b", None), (4, "http://c%20", ""), (5, "http://d\r\nWARC-Refers-To: <urn:page:9:9>", "z" * 10_000), (None, "u%0A", "<p>é"),
    (6, "http://x/ WARC-Refers-To: <urn:page:7:1>\u0085WARC-Type: revisit", "six"), (7, "http://e\n%\r", "six six"), (8, "http://f", "twice"), (8, "http://f", "twice"), (None, None, "alone"), (None, None, "alone"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_contract(spark, tmp_path):
    out = sorted((tuple(r) for r in warc.archived(table(spark, ROWS), str(tmp_path / "w")).collect()), key=repr)
    want, last = [], {}
    for i, _, html in ROWS:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    for i, _, html in ROWS:
        body, of = (html or "").encode(), last.get(html or "")
        revisit = of is not None and of != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    assert out == sorted(want, key=repr)
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == len({html or "" for _, _, html in ROWS})


def test_records_are_exact(spark, tmp_path):
    warc.write_archive(table(spark, ROWS), str(tmp_path / "w"), min_bytes=1, date="2020-02-02T02:02:02Z")
    records = warc.read_archive(spark, str(tmp_path / "w")).collect()
    ids = set()
    for r in records:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert first == "WARC/1.1" and len(fields) == len(lines) and fields["WARC-Date"] == "2020-02-02T02:02:02Z"
        block, close = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
        http, _, body = block.partition(b"\r\n\r\n")
        assert close == b"\r\n\r\n" and http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http; msgtype=response"
        assert body == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"") and fields["WARC-Type"] == r["record_type"]
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(ROWS)
    by_id = {fields_id: r for r in records for fields_id in [bytes(r["record"]).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0]]}
    for r in records:
        if r["record_type"] == "revisit":
            of = by_id[bytes(r["record"]).split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0]]
            assert of["payload"] == r["payload"] and of["page_id"] == r["refers_to"] and of["record_type"] == "response"
    assert sorted(((r["page_id"], r["url"]) for r in records), key=repr) == sorted(((i, u) for i, u, _ in ROWS), key=repr)
    assert {r["page_id"]: r["record_type"] for r in records if r["page_id"] in (3, 4)} == {3: "response", 4: "response"}  # below min_bytes


def test_empty_and_damaged(spark, tmp_path):
    assert warc.archived(table(spark, ROWS).limit(0), str(tmp_path / "e")).collect() == []
    folder = str(tmp_path / "d")
    warc.write_archive(table(spark, ROWS[:1]), folder)
    stored = spark.read.parquet(f"{folder}/payloads").selectExpr("sha256", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(stored, "sha256 binary, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, folder).select("record_type").collect()
