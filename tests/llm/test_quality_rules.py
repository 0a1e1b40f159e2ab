"""The method itself: lines common to a host go, depleted documents are rejected, and the SQL agrees."""

import os

import duckdb
import pytest

from tidemark.llm import quality
from tidemark.llm.oracle import ORACLE

DATA = "/root/testdata/sf0.01"
LONG = "Shared  footer of a site {} with quite a lot of boilerplate words in it that go on and on for ever and ever"
NUMBERS = "\n".join(["Ref 20240101123456789 20240101123456789 20240101123456789 " + " ".join(f"w{k}" for k in range(9))] * 3)


def verdicts(df, **how):
    return sorted(((r["doc_id"], r["base_failed"], r["kept"]) for r in quality.judge(df, **how).collect()), key=repr)


def test_depleted_documents_go(spark):
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    rows = [(k, LONG.format(k) + "\n" + own(k, 4), "s") for k in range(20)]  # a number is one 0 in normal form
    rows += [(100, own(100, 50) + "\n" + LONG.format(7), "s"), (101, LONG.format(5) + "\n" + own(101, 4), "other")]
    rows += [(200 + k, NUMBERS + f"\n{own(k, 3)}", "numbers") for k in range(8)] + [(None, LONG.format(1) + "\n" + own(1, 4), None), (None, None, None), (300, "", "s")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, host string, kept int")
    got = verdicts(df)
    rejected = {i for i, failed, kept in got if not failed and not kept}
    assert rejected == {*range(20)}
    assert {i for i, failed, _ in got if failed} == {None, 300, *range(200, 208)} and (101, False, True) in got and (None, False, True) in got
    again = verdicts(df.unionByName(df))  # rows equal in id and text are one document
    assert again == sorted([*got, *got], key=repr)
    assert verdicts(df, least=21) == [(i, f, not f) for i, f, _ in got] and verdicts(df.limit(0)) == []


def test_copies_count_as_documents(spark):
    text = "\n".join(" ".join(f"{w}{chr(97 + k)}" for k in range(11)) for w in ("one", "two", "three"))
    df = spark.createDataFrame([(k, text, "s") for k in range(6)], "doc_id long, text string, source string")
    assert verdicts(df) == [(k, False, False) for k in range(6)] and verdicts(df.where("doc_id < 5")) == [(k, False, True) for k in range(5)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sql_agrees_where_the_method_rejects(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300").select("doc_id", "text", "source")
    mould = docs.selectExpr("doc_id + 100000 as doc_id", "concat('All rights of this site and its pages are reserved by the owners of it, and no part of it may be copied, kept or sent on in any form without their leave, number ', doc_id, '\\n', substring(text, 1, 60), ' and so on with words to be read') as text", "'src1' as source")
    both = docs.unionByName(mould.where("doc_id < 100200"))
    both.coalesce(1).write.parquet(str(tmp_path / "documents"))
    both = spark.read.parquet(str(tmp_path / "documents"))
    got = quality.judge(both).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = con.sql(ORACLE["op6_quality_rules"]).to_df().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got.columns)].equals(want[sorted(want.columns)])
    assert (~got["base_failed"] & ~got["kept"]).sum() > 20
