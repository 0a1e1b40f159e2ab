"""Secret scans by a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, cut, keyed


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; a match counts if its ``group`` has ``least`` characters.

    ``sure`` is a pattern that every text with a match that counts holds; it spares full scans lists of short matches.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    sure: str = ""


#: The base rules; fixed values.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
]
#: Public token formats that the method adds; fixed values.
ADDED = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
]


#: Classes of up to so many characters are read as alternatives.
_CLASS = 8
_ATOM = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|\[(\^?)((?:\\.|[^\]\\])+)\]|(.)", re.S)
_TIMES = re.compile(r"([?*+]|\{(\d+)(?:,\d*)?\})?")


def _class(negated: str, body: str) -> list[str]:
    """The characters of a class; none if it is negated or has more than a few."""
    if negated or re.search(r"[^\\]-.|\\[a-zA-Z]", body):
        return []
    found = list(dict.fromkeys(re.sub(r"\\(.)", r"\1", body)))
    return found if len(found) <= _CLASS else []


def _ways(pattern: str, at: int) -> tuple[list[list[str]], int]:
    """Each way through the alternatives from ``at`` on: its runs of certain characters, broken where any may stand; and where they end."""
    whole: list[list[str]] = []
    ways: list[list[str]] = [[""]]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            whole, ways, at = whole + ways, [[""]], at + 1
            continue
        if pattern[at] == "(":
            inner, at = _ways(pattern, at + 1 + 2 * pattern.startswith("(?:", at))
        else:
            atom = _ATOM.match(pattern, at)
            code, escaped, negated, body, plain = atom.groups()
            one = _class(negated, body) if body else [] if plain == "." or (escaped or "").isalpha() else [chr(int(code, 16)) if code else escaped or plain]
            inner, at = [[c.lower()] for c in one] or [["", ""]], atom.end() - 1
        times = _TIMES.match(pattern, at + 1)
        at = times.end()
        if times[1] == "?":
            inner = [[""], *inner]
        elif times[1] == "*" or times[2] == "0":
            inner = [["", ""]]
        elif times[1]:  # once or more: what begins a run and what ends one
            inner = [[*way, *way] for way in inner]
        ways = [[*way[:-1], way[-1] + more[0], *more[1:]] for way in ways for more in inner]
    return whole + ways, at


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The trigrams that a match must hold, in lower case: one of these sets, whole. An empty set asks for nothing.

    Literals in a row give their trigrams; alternatives and the characters of small classes give a set each; a part that
    may be missing or stand more than once gives none across it. The grammar is that of the rules: literals, escapes,
    classes, groups, alternatives and counts.
    """
    ways, _ = _ways(pattern.removeprefix("(?i)"), 0)
    sets = {frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in ways}
    return [frozenset()] if frozenset() in sets else sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _clauses(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """``clause, kind, need, trigram``: one row for each trigram of each clause of the rules that have any."""
    rows, number = [], 0
    for rule in rules:
        for clause in trigram_query(rule.pattern):
            number += 1
            rows += [(number, rule.kind, len(clause), t) for t in sorted(clause)]
    return spark.createDataFrame(rows, "clause int, kind string, need int, trigram string")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the trigrams that rules ask for: ``trigram`` and the :data:`common.KEY` of a text that holds it, letters in either case."""
    low = F.lower("text")
    present = F.filter(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)), lambda x: x.isNotNull())
    return docs.where("text is not null").select(*KEY, F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``kinds``: for each text that meets a clause, the rules whose trigram query it meets. From :data:`common.KEY` rows of ``docs``."""
    clauses = _clauses(docs.sparkSession, rules)
    trigrams = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    index = postings(docs, trigrams).distinct()
    met = index.join(clauses, "trigram").groupBy(*KEY, "clause", "kind", "need").agg(F.count("*").alias("have")).where("have = need")
    return met.groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """``(start, order, end)`` of the rule's matches that count, leftmost and without overlap, in code points.

    The text between matches and the matches alternate, so running sums of their lengths are the places.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found, held = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.zip_with(F.split(text, rule.pattern, -1), found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match")))
    pieces = F.zip_with(pieces, held, lambda p, g: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.length(g).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        end = begin + F.coalesce(p["match"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["size"] >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


#: Candidates up to this number, some 100 bytes each, are broadcast; beyond it texts are shuffled to them.
BROADCAST_ROWS = 500_000


def scan(docs: DataFrame, rules: list[Rule] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, found``: for each row of ``docs`` the sorted spans (start, kind's number, end) of the rules' matches.

    Rules with mandatory trigrams are verified only in texts that the index's intersected postings name; a rule that
    lacks them is run over every text. Candidates are keys and kinds without texts; as long as they are at most
    ``broadcast_rows`` they are sent to the texts, else the texts meet them by a shuffle. Null texts are empty and hold
    nothing; repeated rows come back repeated, null ids as null; other columns are ignored. No rows give no rows.
    """
    rules = BASE + ADDED if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern) != [frozenset()]]
    rows = keyed(docs.select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    named = cut(candidates(rows, indexed)).withColumnsRenamed({k: f"_r{k}" for k in KEY})
    named = F.broadcast(named) if named.count() <= broadcast_rows else named
    on = F.lit(True)
    for k in KEY:
        on = on & rows[k].eqNullSafe(named[f"_r{k}"])
    met = rows.join(named, on, "left").select("doc_id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    wanted = lambda r: F.array_contains("kinds", r.kind) if r in indexed else F.col("text").rlike(r.sure) if r.sure else F.lit(True)
    spans = [F.when(wanted(r), _spans(r, i)).otherwise(none) for i, r in enumerate(rules)]
    return met.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` by the base rules and the added ones."""
    rules = BASE + ADDED
    names = F.array(*(F.lit(r.kind) for r in rules))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return scan(docs).select("doc_id", *(number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
