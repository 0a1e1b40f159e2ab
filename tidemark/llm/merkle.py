"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for each document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder

FAN = 16
#: What a leaf holds of a document, in this order; fixed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PART_BITS = 33
_PATH = "array<struct<before: string, after: string>>"


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**replaced: Column) -> Column:
    """A document's digest: each field as ``-`` if null, else its UTF-8 byte count, a colon and the value."""

    def part(name: str) -> Column:
        value = replaced.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return _sha(F.concat(*map(part, FIELDS)))


def _ordered(df: DataFrame, group: list[str], order: list[str], place: str) -> DataFrame:
    """Adds ``place``, each row's number from 0 on in its group by ``order``, nulls first, and ``size``, the group's rows.

    Rows are dealt to sorted ranges, so that a large group spans many tasks, and numbered where they lie. A row for each
    group and range then says how many rows of the group come before.
    """
    rows = cut(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PART_BITS)
    starts = rows.groupBy(part.alias("__part"), *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    all_of, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*(F.col(g).alias(f"__g_{g}") for g in group), "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(all_of).alias("size"))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"__g_{g}")), group, part == F.col("__part"))
    return rows.join(starts, same).withColumn(place, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift", *(f"__g_{g}" for g in group))


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """The runs of ``FAN`` consecutive nodes, in order: ``tree, run_no, run, size``; trees of one node have none."""
    row = F.struct("at", "digest", *more)
    return nodes.where("size > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("run_no")).agg(F.array_sort(F.collect_list(row)).alias("run"), F.first("size").alias("size"))


def _grow(leaves: DataFrame, folder: str) -> int:
    """Write ``leaves(tree, at, digest, size)`` as level 0 of ``folder`` and build the levels above; gives their number.

    ``size`` is the tree's number of nodes on a level. Each level is built by reading the one below and is a sixteenth
    of it; a tree that is down to one node has no further level.
    """
    spark, level = leaves.sparkSession, 0
    leaves.write.parquet(f"{folder}/level=0")
    size = spark.read.parquet(f"{folder}/level=0").agg(F.max("size")).first()[0] or 1
    while size > 1:
        runs = _runs(spark.read.parquet(f"{folder}/level={level}"))
        level, size = level + 1, -(-size // FAN)
        runs.select("tree", F.col("run_no").alias("at"), _sha(F.array_join("run.digest", "")).alias("digest"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size")).write.parquet(f"{folder}/level={level}")
    return level + 1


def _tops(spark: SparkSession, folder: str, levels: int) -> DataFrame:
    """``tree, digest``: the one node that remains of each tree."""
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{folder}/level={k}").where("size = 1").select("tree", "digest") for k in range(levels)))


def _proofs(spark: SparkSession, folder: str, levels: int, above: DataFrame, *carried: str) -> DataFrame:
    """``tree, at, digest, path, top`` of each node of level 0, and the columns ``carried`` of it.

    A path has a step for each run on the way up: the digests ``before`` and ``after`` the node in its run, joined to
    texts; ``top`` is the tree's last node. ``above`` has ``tree, path`` from there on. Levels are read from the top
    down: a run's nodes come together by their coordinates and meet the path of the node above, which is the run's number.
    """
    found = None
    for level in reversed(range(levels)):
        nodes, more = spark.read.parquet(f"{folder}/level={level}"), () if level else carried
        here = nodes.where("size = 1").join(above, "tree").select("tree", "at", "digest", "path", F.col("digest").alias("top"), *more)
        if found is not None:
            parents = found.select("tree", F.col("at").alias("run_no"), "path", "top")
            met = _runs(nodes, *more).join(parents, ["tree", "run_no"]).select("tree", "path", "top", F.col("run.digest").alias("all"), F.posexplode("run").alias("i", "one"))
            side = lambda start, n: F.array_join(F.slice("all", start, n), "")
            step = F.struct(side(F.lit(1), F.col("i")).alias("before"), side(F.col("i") + 2, F.lit(FAN)).alias("after"))
            lower = met.select("tree", "one.at", "one.digest", F.concat(F.array(step), "path").alias("path"), "top", *(f"one.{c}" for c in more))
            here = here.unionByName(lower)
        found = here
    return found


def write_manifest(docs: DataFrame, folder: str, **carried: Column) -> tuple[int, int]:
    """Write the manifest of ``docs(doc_id, source, lang, n_chars, text)`` below ``folder``; gives its numbers of levels.

    ``nodes/level=k`` has ``tree, at, digest, size``: the nodes of each source's tree and, on level 0, ``doc_id`` and the
    columns ``carried``, made of the document's row. A tree's leaves are in the order of their ids, null ids first, and
    rows of one id in that of their digests. ``tops/level=k`` is the tree over the sources' last nodes, in the order of
    the sources' bytes, a null source first; a source's place is its tree's number. Other columns are ignored. Nulls
    have a mark of their own in a digest; null and empty texts differ. Repeated rows are leaves of their own. Documents
    are read once, no text is shuffled and no run of more than sixteen nodes comes together. No rows give empty tables.
    """
    spark = docs.sparkSession
    leaves = docs.select("doc_id", "source", leaf().alias("digest"), *(c.alias(n) for n, c in carried.items()))
    placed = _ordered(leaves, ["source"], ["doc_id", "digest"], "at")
    sources = cut(_ordered(placed.select("source").distinct(), [], ["source"], "tree").select(F.col("source").alias("__s"), "tree", F.col("size").alias("sources")))
    numbered = placed.join(sources, F.col("source").eqNullSafe(F.col("__s")))
    levels = _grow(numbered.select("tree", "at", "digest", "size", "doc_id", *carried), f"{folder}/nodes")
    subroots = _tops(spark, f"{folder}/nodes", levels).join(sources, "tree")
    return levels, _grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.col("sources").alias("size")), f"{folder}/tops")


def read_proofs(spark: SparkSession, folder: str, levels: tuple[int, int], *carried: str) -> DataFrame:
    """``doc_id, leaf, path, subroot, root`` and the columns ``carried`` of each document of a manifest.

    ``path`` leads from the leaf by its source's subroot to the root (see :func:`fold`).
    """
    root = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(_PATH).alias("path"))
    sources = cut(_proofs(spark, f"{folder}/tops", levels[1], root).select(F.col("at").alias("tree"), "path"))
    found = _proofs(spark, f"{folder}/nodes", levels[0], sources, "doc_id", *carried)
    whole = _tops(spark, f"{folder}/tops", levels[1]).select("digest").first()
    return found.select("doc_id", F.col("digest").alias("leaf"), "path", F.col("top").alias("subroot"), F.lit(whole and whole[0]).cast("string").alias("root"), *carried)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to: run by run, with its siblings before and after it."""
    return F.aggregate(path, digest, lambda own, step: _sha(F.concat(step["before"], own, step["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, run by run on the way up, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def tampered_text() -> Column:
    """What the query tampers with: A-Z of the text in lower case."""
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verified(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs``.

    Documents with an id whose decimal CRC-32 five divides are held against the manifest with their letters A-Z in lower
    case, all others as they are; null texts stay null. Rows without an id are not tampered with. Nulls, repeated rows,
    ties and other columns are as for :func:`write_manifest`. No rows give no rows.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=tampered_text()))
    folder = shared_folder(docs, "merkle")
    levels = write_manifest(docs, folder, changed=changed)
    proofs = read_proofs(docs.sparkSession, folder, levels, "changed")
    folded = proofs.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", _sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
