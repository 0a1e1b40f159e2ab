"""Keyword segmentation: the words of search phrases as a column, rows, or a table function of SQL.

Cutting is by :class:`tidemark.functions.segmenter.Segmenter` with a dictionary, the small one of the library unless
another is given. Texts go through Arrow, a batch at a time; the dictionary is built once and sent to each executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segmenter import Segmenter, default_words

LATIN = r"[A-Za-z0-9]+"


def latin_words(text: Column) -> Column:
    """The words of a text without CJK, by built-in functions."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LATIN), F.lit(0)), F.lower)


def _marked(words: Iterable[str | tuple[str, bool]]) -> list[tuple[str, bool]]:
    return [(w, False) if isinstance(w, str) else w for w in words]


def segment(text: str | None, dictionary: Iterable[str | tuple[str, bool]] | None = None) -> list[str]:
    """The words of one text; a dictionary's words are texts, or pairs of a text and whether it is a measure word."""
    return Segmenter(default_words() if dictionary is None else _marked(dictionary))(text)


def segments(spark: SparkSession, dictionary: Iterable[str | tuple[str, bool]] | None = None):
    """A function of columns: the words of each text as an array; none for null."""
    shared = spark.sparkContext.broadcast(Segmenter(default_words() if dictionary is None else _marked(dictionary)))

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = shared.value
        for texts in batches:
            yield pa.array([cut(text) for text in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(over, "array<string>")


def keywords(df: DataFrame, text: str, name: str = "word", dictionary: Iterable[str | tuple[str, bool]] | None = None) -> DataFrame:
    """A row for each word of each row's ``text``, with all its columns and the word as ``name``; on streams, too."""
    return df.withColumn(name, F.explode(segments(df.sparkSession, dictionary)(F.col(text))))


def register(spark: SparkSession, dictionary: Iterable[str | tuple[str, bool]] | None = None, name: str = "ik_analyze") -> None:
    """Make ``name(text)`` a table function with a row for each ``word``, and ``name_words(text)`` the array of them."""
    spark.udf.register(f"{name}_words", segments(spark, dictionary))
    spark.sql(f"create or replace temporary function {name}(text string) returns table (word string) return select explode({name}_words(text))")
