"""Quality rules: word statistics of a document and line frequency across documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, KEY, WORD, cut, keyed, let, words

WINDOW = 8


def _window_hashes(w: Column) -> Column:
    """The hash of each window of eight words, doubled three times from the words' own; none for fewer words."""

    def doubled(h: Column, step: int) -> Column:
        """Each hash with the one ``step`` places on, as long as there is one."""
        return let(h, lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - step, F.lit(0))), F.slice(x, F.lit(step + 1), F.size(x)), lambda a, b: F.xxhash64(a, b)))

    return doubled(doubled(doubled(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)


def _repeated_words(w: Column) -> Column:
    """Words in windows of eight words that stand twice or more in the list.

    Each window's hash is sorted with its place; neighbours with one hash are repeats. Repeated places, sorted again,
    cover their windows' words once each. Time grows with n log n of one text.
    """
    none = F.lit(0).cast("long")

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["at"]))

        gaps = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return let(let(placed, places), lambda p: F.aggregate(gaps(p), none, lambda a, x: a + x))

    return let(_window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))


def word_statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that a verdict needs, with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``.

    word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines: lines with a word that equal
    an earlier line. base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    n = "n_words"
    stats = docs.withColumn("__w", words(F.col("text"))).select(
        *docs.columns,
        F.size("__w").cast("long").alias(n),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("__w")).cast("long").alias("n_repeat_words"),
    )
    return stats.withColumn("base_failed", (F.col(n) < 20) | (100 * F.col("n_repeat_words") > 30 * F.col(n)))


def _line_hashes(docs: DataFrame) -> DataFrame:
    """A row for each line that is not empty in normal form: its two hashes ``h1, h2``, its ``chars``, and ``total`` of the document.

    Normal form: without space at the ends, runs of space as one, runs of digits as one 0, in lower case. ``chars`` and
    ``total`` count characters of it, so that what is removed and what there is are measured alike.
    """
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    normal = F.filter(F.transform(F.split(F.lower(F.regexp_replace(spaced, "[0-9]+", "0")), "\n"), F.trim), lambda x: x != "")
    lines = F.transform(normal, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"), F.length(x).cast("long").alias("chars")))
    whole = docs.select(*KEY, "host", lines.alias("lines"))
    whole = whole.withColumn("total", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"]))
    return whole.select(*KEY, "host", "total", F.posexplode("lines").alias("at", "line")).select(*KEY, "host", "total", "at", "line.*")


def common_lines(lines: DataFrame, documents: DataFrame, share: float, least: int) -> DataFrame:
    """``host, h1, h2`` of the lines in more than ``share`` of the host's documents, and in more than ``least``.

    ``lines(host, h1, h2, KEY)`` and ``documents(host, KEY)``; rows equal in :data:`common.KEY` are one document.
    """
    held = lines.select("host", "h1", "h2", *KEY).distinct().groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hosts = documents.select("host", *KEY).distinct().groupBy("host").agg(F.count("*").alias("documents"))
    return held.join(hosts, "host").where(F.col("n") > F.lit(share) * F.col("documents")).select("host", "h1", "h2")


def judge(docs: DataFrame, share: float = 0.05, least: int = 5, least_left: float = 0.5) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row of ``docs``.

    Lines are hashed in normal form and counted by the distinct documents of their host (the ``source``) that hold
    them. Lines in more than ``share`` of the host's documents, and in more than ``least``, are removed; a document
    that has less than ``least_left`` of its lines' characters left is rejected, as is one whose base rules fail. A
    null source is a host of its own. Null texts have no words and fail. Rows equal in id and text are one document
    and get one verdict each; null ids are judged like any other; other columns are ignored. No rows give no rows.
    """
    rows = keyed(docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host")))
    lines = cut(_line_hashes(rows))  # read twice below
    common = common_lines(lines, rows, share, least)
    removed = lines.join(common, ["host", "h1", "h2"]).select(*KEY, "host", "at", "chars", "total").distinct()
    removed = removed.groupBy(*KEY, "host").agg(F.sum("chars").alias("gone"), F.max("total").alias("total"))
    depleted = removed.where(F.col("gone") > (1 - least_left) * F.col("total")).select(*(F.col(k).alias(f"_r{k}") for k in KEY), F.col("host").alias("_r_host"), F.lit(True).alias("depleted"))
    same = F.col("host") == F.col("_r_host")
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    joined = word_statistics(rows).drop("text").join(depleted, same, "left")
    kept = ~F.col("base_failed") & F.col("depleted").isNull()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
