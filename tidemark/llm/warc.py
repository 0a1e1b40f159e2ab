"""Content-addressed WARC archive: payload bytes once by digest, record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: The base-32 alphabet of RFC 4648; fixed values.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1, 32 characters: five hex digits of it are four of these."""
    digest = F.sha1(payload)

    def four(i: Column) -> Column:
        value = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substr(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*(four(F.lit(i)) for i in range(8)))


#: The profile of a record that repeats a payload; fixed value.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _written(url: Column) -> Column:
    """The header lines of a url. One with a line end is written with ``%``, CR and LF escaped, and a line that says so."""
    escaped = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    broken = F.contains(url, F.lit("\r")) | F.contains(url, F.lit("\n"))
    lines = F.when(broken, F.concat(_line("WARC-Target-URI", escaped), _line("X-Target-URI-Escaped", F.lit("1")))).otherwise(_line("WARC-Target-URI", url))
    return F.when(url.isNotNull(), lines).otherwise("")


def _header(date: str) -> tuple[Column, Column]:
    """The head of the HTTP message, and, from it as ``http``, all bytes of a record before its payload, as text."""
    same = F.col("record_type") == "revisit"
    identity = lambda page, serial: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), serial.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=UTF-8" + CRLF), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    block = F.octet_length("http") + F.when(same, 0).otherwise(F.col("payload_bytes"))
    revisits = F.concat(_line("WARC-Profile", F.lit(REVISIT)), _line("WARC-Refers-To", identity(F.col("last.page_id"), F.col("last.serial"))))
    return http, F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", identity(F.col("page_id"), F.col("serial"))),
        _line("WARC-Date", F.lit(date)),
        _written(F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1_32"))),
        F.when(same, revisits).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages(page_id, url, html)`` below ``folder`` as two Parquet tables.

    ``payloads(sha256, payload)`` holds each distinct payload once. ``headers(page_id, serial, sha256, header)`` holds
    for each record all its bytes before the payload. Of records with equal payloads of at least ``min_bytes`` bytes
    that with the largest page_id is a response and the others are revisits of it; smaller payloads are all responses.
    ``date`` is the capture's, as pages have none. A record's ID has its page_id and a number of its own, so that
    rows repeated or without an id have different ones. A null html is an empty payload; a null url has no target
    line. Rows with the response's id and payload repeated are all responses; rows without an id are revisits where
    their payload has an id, else responses. Other columns are ignored. No rows give two empty tables.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("url"), html.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/payloads")
    small = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1_32"))
    small = cut(small.withColumn("serial", F.monotonically_increasing_id()))  # numbers are given once
    last = small.where("page_id is not null").groupBy("sha256").agg(F.max(F.struct("page_id", "serial")).alias("last"))
    other = (F.col("payload_bytes") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    kinds = small.join(last, "sha256", "left").withColumn("record_type", F.when(other, "revisit").otherwise("response"))
    http, header = _header(date)
    kinds.withColumn("http", http).select("page_id", "serial", "sha256", header.alias("header")).write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/headers")


def _field(lines: Column, name: str) -> Column:
    """The value of the first header line of that name; null if there is none."""
    return F.substring(F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(0)), len(name) + 3, 1 << 30)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Each record rebuilt by joining headers and payloads: ``record`` holds its bytes, the rest is read from them.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, header, payload, sha256, record``. Header
    lines end at CR LF alone. A revisit's record has no payload of its own; ``payload`` is that of the record it refers
    to. A payload that does not give the digest it is stored by or the one its record states, or a record that is not
    as long as it states, stops the job.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    joined = headers.join(payloads, "sha256")
    block_at = F.instr("header", CRLF + CRLF)
    parted = joined.withColumns({"warc": F.substring("header", F.lit(1), block_at - 1), "http": F.substring("header", block_at + 4, F.lit(1 << 30))})
    lines = parted.withColumn("lines", F.split("warc", CRLF))
    body = F.when(_field(F.col("lines"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = lines.withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")))
    named = {"record_type": "WARC-Type", "stated_url": "WARC-Target-URI", "escaped": "X-Target-URI-Escaped", "stated_digest": "WARC-Payload-Digest", "refers": "WARC-Refers-To", "stated_length": "Content-Length"}
    read = whole.withColumns({k: _field(F.col("lines"), v) for k, v in named.items()})
    read = read.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    block = F.octet_length("record") - F.octet_length("warc") - 4 - 4
    faults = F.when(F.unhex(F.sha2("payload", 256)) != F.col("sha256"), "a stored payload does not match its digest")
    faults = faults.when(~F.col("stated_digest").eqNullSafe(F.concat(F.lit("sha1:"), F.col("payload_digest"))), "a payload does not match its record's digest")
    faults = faults.when(~F.col("stated_length").cast("long").eqNullSafe(block.cast("long")), "a record is not as long as it states")
    faults = faults.when(~_field(F.split("http", CRLF), "Content-Length").cast("long").eqNullSafe(F.col("payload_bytes")), "a payload is not as long as its record states")
    sound = read.withColumn("record_type", F.when(faults.isNull(), F.col("record_type")).otherwise(F.raise_error(faults).cast("string")))
    plain = F.replace(F.replace(F.replace("stated_url", F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    refers = F.regexp_extract(F.coalesce("refers", F.lit("")), r"\A<urn:page:(-?\d+):\d+>\z", 1)
    return sound.select(
        "page_id", F.when(F.col("escaped").isNotNull(), plain).otherwise(F.col("stated_url")).alias("url"), "record_type",
        F.when(refers != "", refers.cast("long")).alias("refers_to"), "payload_digest", "payload_bytes", "header", "payload", "sha256", "record",
    )


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to a new archive, rebuild its records and describe each from what was read.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Nulls, repeated rows, ties and clashing names
    are as for :func:`write_archive`. No rows give no rows.
    """
    write_archive(pages, folder)
    records = read_archive(pages.sparkSession, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
