"""URL rules by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    Each distinct host and path is expanded into its host suffixes, as many labels as rules have, joined with its path
    prefixes, as long as rules' paths. These meet the rules on the first four bytes of the SHA-256; the full digest
    confirms. Spark broadcasts the rules only below its own size threshold. Of the rules that fit the longest
    (host and path together, then host) wins, then block before allow. Where none fits, the verdict is ``default``.
    Null urls and those without ``://`` have an empty host and path, which no rule fits. Repeated rows come back
    repeated, null ids as null; other columns are ignored; no rules fit nothing; no rows give no rows.
    """
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    rules = rules.where("rule_host is not null and rule_path is not null and rule_host <> ''")
    rules = rules.withColumn("full", digest(F.col("rule_host"), F.col("rule_path")))
    rules = rules.withColumn("short", F.substring("full", 1, 8))
    # At most as many numbers as the longest rule has labels and characters.
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not labels:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.filter(F.array(*(F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels)), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    expressions = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = expressions.withColumn("url_full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("url_full", 1, 8))
    fits = expressions.join(rules, "short").where("url_full = full")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = fits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(order).alias("best"))
    joined = rows.join(best, (rows["host"] == best["b_host"]) & (rows["path"] == best["b_path"]), "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
