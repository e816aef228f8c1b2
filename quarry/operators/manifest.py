"""Content fingerprints of a corpus, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """name, bytes, sha256 of files(name, content, ...); further columns stay."""
    c = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rest = [x for x in files.columns if x not in ("name", "content")]
    return files.select("name", F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("sha256"), *rest)


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("bytes"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change of every name: added, removed, changed (digest, size or, where both have it, mtime) or same."""
    fields = [c for c in ("bytes", "sha256", "mtime") if c in before.columns and c in after.columns]
    b, a = (d.select("name", F.struct(*fields).alias(n)) for d, n in ((before, "b"), (after, "a")))
    both = b.join(a, "name", "full_outer")
    return both.select("name", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("change"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files before and after, and whether nothing changed."""
    d = diff(before, after)
    return d.agg(F.count_if(F.col("change") != "added").alias("before"), F.count_if(F.col("change") != "removed").alias("after"), F.coalesce(F.bool_and(F.col("change") == "same"), F.lit(True)).alias("unchanged"))
