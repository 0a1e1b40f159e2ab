"""What the training-data operators share: words, row keys, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _checkpoint_folder(context) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; on one machine alone a temporary one where it names none."""
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    _checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{_checkpoint_folder(df.sparkSession.sparkContext)}/{name}-{uuid.uuid4().hex}"


#: What tells rows apart in joins back to them: the id and the text. Rows equal in both are one document.
KEY = ("__id", "__hash", "__len")


def keyed(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    return df.withColumns({"__id": F.col(id_column), "__hash": F.xxhash64(F.lit(7), F.col(text)), "__len": F.coalesce(F.octet_length(F.col(text)), F.lit(-1))})


def join_back(df: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``df`` with :data:`KEY` joined with ``found`` on it; null ids are equal. The key goes."""
    right = found.withColumnsRenamed({k: f"_r{k}" for k in KEY})
    on = F.lit(True)
    for k in KEY:
        on = on & df[k].eqNullSafe(right[f"_r{k}"])
    return df.join(right, on, how).drop(*KEY, *(f"_r{k}" for k in KEY))
