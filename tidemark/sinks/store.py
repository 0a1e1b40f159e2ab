"""Keyed tables as folders of batches under versions: upserts, tombstones, readers that hold on to one version."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folders

#: The column that marks a row as the end of its key.
DELETED = "__deleted"


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    ranked = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("__n", F.row_number().over(ranked)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class Version:
    """What a table is made of: the merged folder, if any, the batches after it, and the rows' schema."""

    id: int
    merged: int | None
    batches: tuple[int, ...]
    schema: T.StructType

    def text(self) -> str:
        return json.dumps({"id": self.id, "merged": self.merged, "batches": self.batches, "schema": self.schema.jsonValue()})

    @staticmethod
    def of(text: str) -> Version:
        found = json.loads(text)
        return Version(found["id"], found["merged"], tuple(found["batches"]), T.StructType.fromJson(found["schema"]))


class KeyedStore:
    """The last row of each key, written batch by batch.

    :meth:`write` is a ``foreachBatch`` function. A batch is cut down to a row for each key, the last by ``order``, and
    written to a folder of its own; rows with :data:`DELETED` set end their key. Then a small file names the new version
    in one move. A replayed batch replaces its folder and its version. After ``every`` batches the rows that live are
    merged into one folder. Folders that none of the last ``keep`` versions uses are removed, so a reader has as many
    batches' time to finish. Columns ``parts`` lie in folders of their own, so that a read of one value leaves the
    others out. Columns may be added from batch to batch; rows without them have nulls there.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str] = (), every: int = 16, keep: int = 2, parts: Sequence[str] = ()):
        self.path, self.keys, self.order, self.every, self.keep, self.parts = path, list(keys), list(order), every, keep, list(parts)

    def _versions(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in folders.names(spark, f"{self.path}/_versions") if n.endswith(".json")]

    def _load(self, spark: SparkSession, number: int) -> Version:
        return Version.of(folders.read_text(spark, f"{self.path}/_versions/{number:020d}.json"))

    def version(self, spark: SparkSession) -> Version | None:
        """The newest version; none before the first batch."""
        found = self._versions(spark)
        return self._load(spark, max(found)) if found else None

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/kind={kind}/at={number}"

    def _rows(self, spark: SparkSession, version: Version) -> DataFrame:
        """The last row of each key of a version, ended keys too."""
        found = [*([self._folder("merged", version.merged)] if version.merged is not None else []), *(self._folder("batch", b) for b in version.batches)]
        if not found:
            return spark.createDataFrame([], version.schema)
        schema = T.StructType([*version.schema.fields, T.StructField("kind", T.StringType()), T.StructField("at", T.LongType())])
        rows = spark.read.schema(schema).option("basePath", self.path).parquet(*found)
        return latest(rows, self.keys, ["at"]).select(*version.schema.names)

    def read(self, spark: SparkSession, version: Version | None = None) -> DataFrame | None:
        """The rows that live in a version, the newest unless one is given; none before the first batch."""
        version = version or self.version(spark)
        return self._rows(spark, version).where(~F.col(DELETED)).drop(DELETED) if version else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, self.keys, self.order) if self.order else batch.dropDuplicates(self.keys)
        rows = rows.withColumn(DELETED, F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in batch.columns else F.lit(False))
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(self._folder("batch", batch_id))
        before = max((n for n in self._versions(spark) if n < batch_id), default=None)
        old = self._load(spark, before) if before is not None else Version(-1, None, (), T.StructType([]))
        known = {f.name for f in old.schema.fields}
        schema = T.StructType([*old.schema.fields, *(T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in known)])
        new = Version(batch_id, old.merged, (*old.batches, batch_id), schema)
        if len(new.batches) >= self.every:
            live = self._rows(spark, new).where(~F.col(DELETED))
            live.write.mode("overwrite").partitionBy(*self.parts).parquet(self._folder("merged", batch_id))
            new = Version(batch_id, batch_id, (), schema)
        folders.put_text(spark, f"{self.path}/_versions/{batch_id:020d}.json", new.text())
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        found = self._versions(spark)
        kept = [self._load(spark, n) for n in found[-self.keep :]]
        used = {("merged", v.merged) for v in kept} | {("batch", b) for v in kept for b in v.batches}
        for number in found[: -self.keep]:
            folders.remove(spark, f"{self.path}/_versions/{number:020d}.json")
        newest = kept[-1].id
        for kind in ("batch", "merged"):
            for name in folders.names(spark, f"{self.path}/kind={kind}"):
                number = int(name.removeprefix("at="))
                # What a version still uses stays, and so does the last batch, which a restart may replay.
                if number < newest and (kind, number) not in used:
                    folders.remove(spark, self._folder(kind, number))
