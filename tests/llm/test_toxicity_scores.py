"""Every score against a plain walk down the fitted trees and the isotonic steps, from plainly counted features."""

import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import toxicity

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 8))) for _ in range(80)]
SCHEMA = "doc_id long, text string, lang string, source string, score string, raw double, features string"


def table(spark):
    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        extra = RNG.choice([["wexlor", "you"], ["IDIOT", "your", "grubnik!"], ["you", "m0ron", "wexlor"], ["st*pid", "wexlors"]]) if bad else RNG.choice([["you"], ["fine"], []])
        body = [RNG.choice(WORDS) for _ in range(RNG.choice([3, 30, 200]))]
        for w in extra:
            body.insert(RNG.randrange(len(body) + 1), w)
        rows.append((i, " ".join(body) + RNG.choice(["", "!", " ... ?!"]), "en", "s", "x", 1.0, "y"))
        labels.append((i, int(bad)))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s", "x", 1.0, "y"), (None, "you wexlor grubnik " * 50, "de", None, "x", 1.0, "y"), rows[3], rows[3], (902, "Ünïdiot idiot. " * 20_000, "fr", "s", "x", 1.0, "y")]
    return rows, labels


def features(text, words, starts):
    """The dense features, counted one by one."""
    text = text or ""
    tokens, raw = re.findall(r"[^\W\d_]+", text.lower()), text.split()
    is_bad = lambda t: t in toxicity.LEXICON or t in words or t[:5] in starts
    n, letters = len(tokens) or 1, sum(len(t) for t in tokens) or 1
    near, seen = 0, {"bad": -10, "second": -10}
    if any(map(is_bad, tokens)) and any(t in toxicity.SECOND_PERSON for t in tokens):
        for i, t in enumerate(tokens):
            kind = "bad" if is_bad(t) else "second" if t in toxicity.SECOND_PERSON else None
            if kind:
                near += i - seen["second" if kind == "bad" else "bad"] <= 4
                seen[kind] = i
    disguised = [w for w in raw if not w.isalpha() and any(c in "013457@$!*" for c in w[:-1]) and any(c.isalpha() for c in w)]
    plain = [w.lower().translate(toxicity.DISGUISE).strip(".,;:?i") for w in disguised]
    lexicon, learned, begun = (sum(1 for t in tokens if is_bad(t) and ok(t)) for ok in (lambda t: t in toxicity.LEXICON, lambda t: t in words, lambda t: t[:5] in starts))
    second = sum(t in toxicity.SECOND_PERSON for t in tokens)
    return [
        1000 * lexicon / n, 1000 * learned / n, 1000 * begun / n, 1000 * near / n, 1000 * second / n, sum(c.isupper() for c in text) / letters, sum(w.isupper() and len(w) > 2 for w in raw) / n, text.count("!") / n,
        sum(c in "?!.,;:*#" for c in text) / n, len(disguised) / n, 1000 * sum(p in toxicity.LEXICON or p in words for p in plain) / n, min(lexicon + learned + begun, 50), min(n, 2000),
    ]


def walk(lines, x):
    """What a tree's printed form predicts."""
    depth = lambda s: len(s) - len(s.lstrip())
    at = 0
    while True:
        line = lines[at].strip()
        if line.startswith("Predict"):
            return float(line.split(": ")[1])
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        if x[int(feature)] <= float(limit):
            at += 1
        else:
            at = next(k for k in range(at + 1, len(lines)) if depth(lines[k]) == depth(lines[at])) + 1


def plain_score(model, text):
    x = features(text, *model.lexicon)
    margin = sum(w * walk(t.toDebugString.splitlines()[1:], x) for t, w in zip(model.trees.trees, model.trees.treeWeights))
    raw = 1 / (1 + math.exp(-2 * margin))
    at, to = list(model.calibration.boundaries), list(model.calibration.predictions)
    if raw <= at[0] or raw >= at[-1]:
        step = to[0] if raw <= at[0] else to[-1]
    else:
        k = next(k for k in range(1, len(at)) if at[k] >= raw)
        step = to[k] if at[k] == raw or at[k] == at[k - 1] else to[k - 1] + (to[k] - to[k - 1]) * (raw - at[k - 1]) / (at[k] - at[k - 1])
    return max(0.0, min(1.0, 0.99 * step + 0.01 * raw))


def test_scores(spark):
    rows, labels = table(spark)
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.ToxicityModel.fit(docs, known)
    scored = model.score(docs.select("doc_id", "text")).collect()
    plain = {t: plain_score(model, t) for _, t, *_ in rows}
    assert len(scored) == len(rows) and all(abs(r["__score"] - plain[r["text"]]) < 1e-9 for r in scored)
    held = [r for r in scored if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] < 500]
    assert sum((r["__score"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and sorted(repr(tuple(r)) for r in kept.collect()) == sorted(repr(r) for r in rows if plain[r[1]] < 0.7)
    # Labels of held-out rows change nothing, nor do ids, languages and sources.
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    judged = lambda d, k: sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in toxicity.judge(d, k).collect()), key=repr)
    first = judged(docs, known)
    assert first == judged(docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")}), turned)
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and p == int(s >= 0.7) for i, h, s, p in first)
    assert toxicity.judge(docs.limit(0), known).count() == 0 and toxicity.without_toxic(docs.limit(0), known).count() == 0
