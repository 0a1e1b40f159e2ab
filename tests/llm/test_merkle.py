"""The manifest against a plain tree, and what it is for: a changed document no longer leads to the root."""

import os

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, size long, tree long, path string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(docs):
    return sorted(brute.merkle([tuple(r) for r in docs.select(*merkle.FIELDS).collect()]), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_manifest_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = rows(merkle.verified(docs))
    assert found == plain(docs) and {r[-1] for r in found} == {True, False}


def test_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, clashing names, lone leaves and no rows."""
    odd = [(None,) * 5, (None, None, None, None, ""), (None, "a", "e", 1, "x"), (1, "a", "e", 1, "Xé"), (1, "a", "e", 1, "Xé"), (1, "a", "e", 1, "yy"), (900, "z", "q", 1, "AB " * 200_000)]
    odd += [(k, "é" if k % 3 else "", None, k, "T" * k) for k in range(300)]
    docs = spark.createDataFrame([(*r, 1, 2, "p") for r in odd], SCHEMA).repartition(3)
    for some in (docs, docs.where("doc_id = 900"), docs.where("doc_id = 1"), docs.limit(0)):
        assert rows(merkle.verified(some)) == plain(some)


def test_a_source_of_many_ranges_and_sources_of_one(spark, tmp_path):
    """One source holds most rows, and there are more sources than one run of the tree above them takes."""
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 287)).alias("source"), F.lit("en").alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.repeat(F.lit("A"), F.col("id").cast("int") % 11).alias("text"))
    assert rows(merkle.verified(docs)) == plain(docs)
    levels = merkle.write_manifest(docs, str(tmp_path / "m"))
    sizes = [spark.read.parquet(str(tmp_path / f"m/nodes/level={k}")).where("size > 1 or tree = 0").count() for k in range(levels[0])]
    assert sizes[0] == 6_000 and sizes == sorted(sizes, reverse=True) and levels[1] == 3
    proofs = merkle.read_proofs(spark, str(tmp_path / "m"), levels)
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert proofs.where(merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).isEmpty()
