"""Dictionary segmentation against all cuts by brute force, and the table function on batches and streams."""

import random
from itertools import combinations

import pytest

from tidemark.functions import text
from tidemark.functions.segmenter import NUMERALS, Segmenter, Trie, read_words
from tidemark.streaming import jobs


def every_cut(words, run):
    """The best of all ways to cut a run, by the rules as the segmenter states them."""
    found = []
    for n in range(len(run)):
        for cuts in combinations(range(1, len(run)), n):
            bounds = [0, *cuts, len(run)]
            pieces, covered, count, product, weight = [], 0, 0, 1, 0
            for a, b in zip(bounds, bounds[1:]):
                numeral = all(c in NUMERALS for c in run[a:b]) and (a == 0 or run[a - 1] not in NUMERALS) and (b == len(run) or run[b] not in NUMERALS)
                if run[a:b] in words or numeral:
                    count += 1
                    covered, product, weight = covered + b - a, product * (b - a), weight + count * (b - a)
                elif b - a > 1:
                    break
                pieces.append(run[a:b])
            else:
                found.append(((covered, -count, product, weight), pieces))
    best = max(f[0] for f in found)
    return [pieces for value, pieces in found if value == best]


def test_every_split_is_a_best_one():
    rng = random.Random(5)
    for letters in ("天地人", "天地人和三十"):
        for _ in range(150):
            words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
            run = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 11)))
            assert [w for w, _ in Segmenter((w, False) for w in words).split(run)] in every_cut(words, run)


def test_trie_finds_all_words():
    rng = random.Random(7)
    words = {"".join(chr(0x4E00 + int(rng.expovariate(0.02))) for _ in range(rng.randrange(1, 6))) for _ in range(4_000)}
    trie = Trie((w, len(w) == 2) for w in words)
    for _ in range(400):
        run = "".join(rng.sample(sorted(words), 3)) + "龠"
        for at in range(len(run)):
            assert list(trie.matches(run, at)) == [(e, 2 if e - at == 2 else 1) for e in range(at + 1, len(run) + 1) if run[at:e] in words]
    assert list(Trie([]).matches("天", 0)) == []


def test_ambiguous_phrases():
    words = ["运动", "运动鞋", "鞋子", "动鞋", "果汁", "苹果", "苹果汁", "汁水", "水杯"]
    assert text.segment("运动鞋子", words) == ["运动", "鞋子"]  # all covered in two words, not three covered in one
    assert text.segment("苹果汁", words) == ["苹果汁"]  # fewest words
    assert text.segment("苹果汁水杯", words) == ["苹果汁", "水杯"]  # all covered
    assert text.segment("运动鞋", ["运", "动鞋", "运动", "鞋"]) == ["运", "动鞋"]  # the longer word comes later
    assert text.segment("人运动人", ["运动"]) == ["人", "运动", "人"]


def test_default_dictionary_and_numbers():
    assert text.segment("新款保温杯 350毫升 三件套装") == ["新款", "保温杯", "350毫升", "三件", "套装"]
    assert text.segment("牛奶二十四盒/箱") == ["牛奶", "二十四盒", "箱"] and text.segment("2万米") == ["2万米"]
    assert text.segment("USB-C充电器 Type2 不锈钢") == ["usb", "c", "充电器", "type2", "不锈钢"]
    assert text.segment(None) == [] and text.segment("") == [] and text.segment(" ,。") == []
    assert text.segment("纯棉" * 2_000) == ["纯棉"] * 2_000


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# notes\n龙井茶\n\n两\tm\n茶 # a note\n", encoding="utf-8")
    words = read_words(spark, str(tmp_path / "words.txt"))
    assert words == [("龙井茶", False), ("两", True), ("茶", False)] and text.segment("5两龙井茶", words) == ["5两", "龙井茶"]
    with pytest.raises(ValueError, match="lines"):
        read_words(spark, str(tmp_path / "words.txt"), most=2)


def test_table_function(spark, tmp_path):
    rows = [(1, "红色水杯 Cup"), (2, None), (3, ""), (4, "cup cup")]
    df = spark.createDataFrame(rows, "id int, item string")
    want = [(1, "cup"), (1, "水杯"), (1, "红色"), (4, "cup"), (4, "cup")]
    assert sorted(map(tuple, text.keywords(df, "item").select("id", "word").collect())) == want
    text.register(spark, ["红", "水杯"])
    got = spark.sql("select id, word from {df}, lateral ik_analyze(item)", df=df)
    assert sorted(map(tuple, got.collect())) == [(1, "cup"), (1, "水杯"), (1, "红"), (1, "色"), *want[3:]]
    assert [r[0] for r in spark.sql("select word from ik_analyze('水杯 A1')").collect()] == ["水杯", "a1"]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run(text.keywords(stream, "item").select("id", "word"), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    plan = text.keywords(df, "item")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
