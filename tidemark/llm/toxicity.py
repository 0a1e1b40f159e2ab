"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Insults that any text may hold; fixed values. What the labels add is learned.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown jerk fool creep imbecile ugly vermin".split()
    + "dumm trottel arschloch abschaum widerlich idioten verlierer stupide imbécile crétin ordure minable dégoûtant idiota estúpido basura imbécil asqueroso perdedor inútil".split()
)
#: The second person in four languages; fixed values.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine euch euer tu te toi ton ta vous votre vos usted ustedes tus vosotros".split())
#: Signs written for letters; fixed values.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
FEATURES = ["lexicon", "learned", "learned_starts", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated", "disguised_lexicon", "hits", "length"]
_WORD = re.compile(r"[^\W\d_]+")
_RAW = re.compile(r"\S+")
_START = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(text: str | None, words: frozenset[str], starts: frozenset[str]) -> list[float]:
    text = text or ""
    raw = _RAW.findall(text)
    low = text.lower()
    tokens = _WORD.findall(low)
    n = max(len(tokens), 1)
    counts = Counter(tokens)
    bad = {t for t in counts if t in LEXICON or t in words or t[:_START] in starts}
    lexicon = sum(counts[t] for t in bad if t in LEXICON)
    learned = sum(counts[t] for t in bad if t in words)
    begun = sum(counts[t] for t in bad if t[:_START] in starts)
    second = sum(c for t, c in counts.items() if t in SECOND_PERSON)
    near = 0
    if bad and second:
        last_bad = last_second = -10
        for i, t in enumerate(tokens):
            if t in bad:
                last_bad = i
                near += i - last_second <= 4
            elif t in SECOND_PERSON:
                last_second = i
                near += i - last_bad <= 4
    letters = sum(map(len, tokens)) or 1
    disguised = [w for w in raw if not w.isalpha() and any(c in "013457@$!*" for c in w[:-1]) and any(c.isalpha() for c in w)]
    plain = [w.lower().translate(DISGUISE).strip(".,;:?i") for w in disguised]
    return [
        1000 * lexicon / n, 1000 * learned / n, 1000 * begun / n, 1000 * near / n, 1000 * second / n,
        sum(map(str.isupper, text)) / letters, sum(w.isupper() and len(w) > 2 for w in raw) / n, text.count("!") / n,
        sum(text.count(c) for c in "?!.,;:*#") / n, len(disguised) / n, 1000 * sum(p in LEXICON or p in words for p in plain) / n,
        float(min(lexicon + learned + begun, 50)), float(min(n, 2000)),
    ]


def featured(docs: DataFrame, lexicon: tuple[frozenset[str], frozenset[str]]) -> DataFrame:
    """All columns of ``docs`` and ``__x array<double>``, the dense features of the whole text; null is an empty text."""
    words, starts = lexicon
    run = F.pandas_udf(lambda s: pd.Series([_features(t, words, starts) for t in s], dtype="object"), "array<double>")
    return docs.withColumn("__x", run("text"))


def learn_lexicon(texts: DataFrame, most: int = 2048, least_gain: float = 20.0) -> tuple[frozenset[str], frozenset[str]]:
    """The words, and the first five letters of words, that stand in more of the toxic ``texts(text, toxic)`` than chance gives.

    ``most`` of each at most, by the likelihood ratio, which has to reach ``least_gain``.
    """
    tokens = F.pandas_udf(lambda s: pd.Series([sorted({w for t in set(_WORD.findall((x or "").lower())) for w in ((t, t[:_START] + "*") if len(t) > _START else (t,))}) for x in s], dtype="object"), "array<string>")
    totals = texts.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, total = totals["t"] or 0, totals["n"]
    if not toxic or toxic == total:
        return frozenset(), frozenset()
    counts = texts.select("toxic", F.explode(tokens("text")).alias("w")).groupBy("w").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("m")).where("k >= 3")
    xlog = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = toxic / total
    gain = 2 * (xlog(F.col("k"), F.col("m") * share) + xlog(F.col("m") - F.col("k"), F.col("m") * (1 - share)))
    found = counts.where(F.col("k") / F.col("m") > 3 * share if share < 0.25 else F.col("k") / F.col("m") > 0.75).withColumn("gain", gain).where(F.col("gain") >= least_gain)
    is_start = F.col("w").endswith("*")
    top = lambda rows: frozenset(r["w"].rstrip("*") for r in rows.orderBy(F.desc("gain"), "w").limit(most).collect())
    return top(found.where(~is_start)), top(found.where(is_start))


class ToxicityModel:
    """Trees and calibration learned from labelled documents, and the scores they give."""

    def __init__(self, lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, rounds: int = 20, depth: int = 3) -> ToxicityModel:
        """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, held-out documents left out.

        ``max_labelled`` bounds the sample of labelled documents that is learned from; they are taken in the order of a
        hash of the id, four of five for the lexicon and the trees, one for the calibration. Labels that are null or
        without an id are left out; of several labels of one id the largest counts. With labels of one class alone, or
        none, no trees are learned and the score is the lexicon's.
        """
        order = F.xxhash64(F.lit("labels"), "doc_id")
        known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        known = known.withColumn("order", order).orderBy("order", "doc_id").limit(max_labelled)
        sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_labelled rows of two numbers at most
        sample = cut(sample.select("text", "toxic", (F.pmod("order", F.lit(5)) == 0).alias("calibrates")).repartition(12))
        lexicon = learn_lexicon(sample.where("not calibrates"))
        rows = cut(_vectors(featured(sample, lexicon)).select("features", F.col("toxic").cast("double").alias("label"), "calibrates"))
        kinds = rows.groupBy("calibrates").agg(F.count_distinct("label").alias("n")).collect()
        if {r["calibrates"] for r in kinds if r["n"] == 2} != {True, False}:
            return cls(lexicon, None, None)
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1, minInstancesPerNode=3).fit(rows.where("not calibrates").coalesce(6))
        raw = trees.transform(rows.where("calibrates")).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="__score").fit(raw)
        return cls(lexicon, trees, calibration)

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` and ``__score double`` from 0 to 1 of the whole text; a null text is empty.

        The calibrated score is blended with a hundredth of the trees' own, so that documents of one step stay in order.
        """
        if self.trees is None:
            wide = featured(docs, self.lexicon)
            return wide.withColumn("__score", F.when(F.get("__x", F.lit(FEATURES.index("hits"))) > 0, 0.9).otherwise(0.05)).drop("__x")
        wide = self.trees.transform(_vectors(featured(docs, self.lexicon))).withColumn("raw", vector_to_array("probability")[1])
        scored = self.calibration.transform(wide.drop("features", "rawPrediction", "probability", "prediction"))
        return scored.withColumn("__score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("__score") + 0.01 * F.col("raw")))).drop("raw", "__x")


def _vectors(df: DataFrame) -> DataFrame:
    columns = [f"__f{i}" for i in range(len(FEATURES))]
    wide = df.withColumns({c: F.get("__x", F.lit(i)) for i, c in enumerate(columns)})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(wide).drop(*columns)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Only the text is scored: labels, languages, sources and ids are no inputs. Null and empty texts get the score of
    an empty text. Repeated rows come back repeated, null ids as null and not held out. No rows give no rows.
    """
    model = ToxicityModel.fit(docs, labels)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    model = ToxicityModel.fit(docs, labels)
    scored = model.score(docs.select(F.struct(*docs.columns).alias("__row"), "text"))
    return scored.where(F.col("__score") < threshold).select("__row.*")
