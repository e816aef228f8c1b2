"""Paths and folder digests of a tree of files (an extension).

paths() turns (id, parent, name) into paths by pointer doubling: every round a node takes over its ancestor's ancestor, so that
a tree of depth d takes log2(d) rounds, each a written table. Folder digests roll the files' digests up their folders, so that
two snapshots are compared from the top and only what differs is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]


def paths(nodes: DataFrame, keep: Keep) -> DataFrame:
    """id, path, status of nodes(id, parent, name). ok: the names from a root (a node without a parent) down, each after a
    slash. orphan: an ancestor is missing. cycle: the node is among its own ancestors or below such a node. Only ok has a
    path. Rows without an id are no nodes; of rows of one id the smallest (parent, name), without a parent first, counts;
    a null name is ''.

    While nodes of finite depth are open, each round closes one at least: those at depth 2^k and beyond have one at 2^k among
    their ancestors. So when a round closes none, all that is left hangs on a cycle. keep writes a table and reads it again."""
    one = nodes.where("id is not null").groupBy("id").agg(F.min(F.struct("parent", F.coalesce("name", F.lit("")).alias("name"))).alias("n"))
    rows = keep(one.select("id", F.col("n.parent").alias("up"), F.concat(F.lit("/"), "n.name").alias("path"), F.lit(False).alias("lost")))
    left = rows.where("up is not null").count()
    while left:
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("lost").alias("gone"), F.lit(True).alias("known"))
        step = rows.where("up is not null").join(above, "up", "left")
        lost = F.col("known").isNull() | F.col("gone")
        moved = step.select("id", F.when(~lost, F.col("next")).alias("up"), F.when(~lost, F.concat("head", "path")).alias("path"), lost.alias("lost"))
        rows = keep(rows.where("up is null").unionAll(moved))
        now = rows.where("up is not null").count()
        if now == left:
            break
        left = now
    status = F.when(F.col("up").isNotNull(), "cycle").when(F.col("lost"), "orphan").otherwise("ok")
    return rows.select("id", F.when(status == "ok", F.col("path")).alias("path"), status.alias("status"))


LANES, BUCKETS = 4, 256


def _sums(prefix: str = "") -> list:
    return [F.sum(f"{prefix}h{i}").alias(f"h{i}") for i in range(LANES)]


def folder_digests(manifest: DataFrame) -> DataFrame:
    """folder, level, files, bytes, digest of manifest(name, bytes, sha256): a row for each folder of any name and for the
    root ''. A file counts in each folder above it: a folder's digest is made from sums of four 60-bit pieces of
    sha256(name, size, digest) of the files below, so that partial sums can be added before they are shuffled, and no
    folder's list of files is ever held. Folders with equal digests hold the same files, but for chance of 2^-200 and so;
    this is no proof against someone who makes up files to that end. Sums of files are folded by folder first, then those of
    folders by their ancestors."""
    fresh = F.sha2(F.concat_ws("\u0000", "name", F.col("bytes").cast("string"), "sha256"), 256)
    lanes = [F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"h{i}") for i in range(LANES)]
    rows = manifest.select("name", "bytes", fresh.alias("h")).select(parent("name").alias("folder"), "bytes", *lanes)
    own = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *_sums())
    at = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.struct(F.lit("").alias("folder"), F.lit(0).alias("level")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.struct(F.array_join(F.slice(at, F.lit(1), k), "/").alias("folder"), k.alias("level"))))
    spread = own.select(F.explode(above).alias("f"), "files", "bytes", *[f"h{i}" for i in range(LANES)]).select("f.folder", "f.level", "files", "bytes", *[f"h{i}" for i in range(LANES)])
    all_ = spread.groupBy("folder", "level").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), *_sums())
    return all_.select("folder", "level", "files", "bytes", F.sha2(F.concat_ws(",", F.col("files").cast("string"), *[F.col(f"h{i}").cast("string") for i in range(LANES)]), 256).alias("digest"))


def parent(name: str):
    """The folder of a name without a slash at either end; '' for none."""
    return F.regexp_replace(F.col(name), "/?[^/]*$", "")


def _bucket(folder: str):
    return F.pmod(F.xxhash64(folder), F.lit(BUCKETS)).cast("int")


class Snapshot:
    """A manifest as written tables: folders by level, files by a bucket of their folder. Both are dealt by ranges, so that a
    bucket with a huge folder takes several tasks and the others few files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, manifest: DataFrame) -> "Snapshot":
        m = manifest.select("name", "bytes", "sha256", parent("name").alias("folder"))
        m.withColumn("bucket", _bucket("folder")).repartitionByRange("bucket", "name").write.partitionBy("bucket").parquet(f"{self.root}/files")
        folders = folder_digests(self.files().select("name", "bytes", "sha256")).withColumn("above", F.when(F.col("level") > 0, parent("folder")))
        folders.repartitionByRange("level", "folder").write.partitionBy("level").parquet(f"{self.root}/folders")
        return self

    def files(self) -> DataFrame:
        return self.spark.read.schema("name string, bytes long, sha256 string, folder string, bucket int").parquet(f"{self.root}/files")

    def level(self, k: int) -> DataFrame:
        rows = self.spark.read.schema("folder string, files long, bytes long, digest string, above string, level int").parquet(f"{self.root}/folders")
        return rows.where(F.col("level") == k).select("folder", "digest", "above")


def changed_folders(before: Snapshot, after: Snapshot, keep: Keep) -> DataFrame:
    """folder of every folder whose digest differs or that only one of the two has, from the root down: a level's folders are
    compared only below those that differ, and the walk ends at the first level where all are equal."""
    found, k = None, 0
    while True:
        b, a = before.level(k), after.level(k)
        if k:
            open_ = last.select(F.col("folder").alias("above"))  # noqa: F821
            b, a = (d.join(open_, "above", "left_semi") for d in (b, a))
        both = b.select("folder", F.col("digest").alias("b")).join(a.select("folder", F.col("digest").alias("a")), "folder", "full_outer")
        last = keep(both.where(~F.equal_null("a", "b")).select("folder"))
        found = last if found is None else found.unionAll(last)
        if last.isEmpty():
            return found
        k += 1


def diff(before: Snapshot, after: Snapshot, keep: Keep) -> DataFrame:
    """name, change of the files that are not the same, as manifest.diff says it. Of the files only the buckets that hold a
    changed folder are read; their numbers, BUCKETS at most, go through the driver."""
    from quarry.operators import manifest

    folders = keep(changed_folders(before, after, keep))
    buckets = [r[0] for r in folders.select(_bucket("folder").alias("b")).distinct().collect()]
    mine = lambda s: s.files().where(F.col("bucket").isin(buckets)).join(folders, "folder", "left_semi").select("name", "bytes", "sha256")
    return manifest.diff(mine(before), mine(after)).where("change <> 'same'")
