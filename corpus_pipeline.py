"""A training-data pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, simhash, toxicity
from tidemark.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts score as an empty text. Rows repeated or without an id are scored like any other; rows of one
    text have one score. Columns of any name go on as they are. No rows give no rows.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words go, and documents of which nothing is left.

    Null and empty texts stay. The copy in the smallest id stays, null ids come last; rows equal in id and text are one
    document and lose the same lines. Columns of any name but ``n_deleted`` go on as they are. No rows give no rows.
    """
    cleaned = lines.dedup_lines(docs)
    left = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0
    return cleaned.where((F.col("n_deleted") == 0) | left).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingle sets linked from a Jaccard similarity of 0.8 on.

    Texts meet by SimHash fingerprints in balls of two bits, and, where these do not reach, by minima of their shingles;
    the exact similarity decides.

    That with the smallest id stays, and all rows of that id. Rows without an id stay. Null and empty texts are copies
    of each other. Columns of any name go on as they are. No rows give no rows.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each partition in the order of its slots.

    Null and empty texts have no words, so the mix takes none of them. A null source is one of its own. Null ids and
    repeated rows are rows like any other. Columns of any name go on as they are. No rows give no rows.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, ids, n_tokens, decoded``: the token ids of each document, and the text decoded from them.

    Null and empty texts have no ids and an empty ``decoded``. Rows repeated or without an id come back as often. Columns
    of these names are replaced, others left out. No rows give no rows.
    """
    coded = bpe.encode(docs, *vocabulary(), columns=["doc_id", "source"])
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("mixing", mix_sources), ("byte_bpe", tokenize)]

#: Trained trees, fingerprints and merges are beyond SQL; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
