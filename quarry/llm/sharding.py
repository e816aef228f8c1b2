"""Sharding by extendible hashing (native: DataFrame functions only).

A document's hash is the first 60 bits of md5 over its key; the directory is indexed by a prefix of those bits. A
bucket is split on one more bit only while it is above the byte limit, so a leaf is the shortest prefix whose bytes fit.
All split decisions follow from one histogram: bytes per cell at a depth a few bits below the expected one, summed for
each prefix of the cell (map-side combined). Cells still above the limit get a deeper histogram of their rows alone.

At 60 bits only rows with one and the same key are left together. Such a leaf becomes overflow pages: rows are ranked
by a two-level count (rows per block of the stored table, then within a block), as many a page as fit by the largest
row, so a key with a third of all rows never meets in one task.

The directory's index is the first global_depth bits (the deepest leaf's) of the hash; a leaf of less depth fills a run of
slots, so directory() gives runs and not single slots, of which there may be 2**60.

Defined results: null text has 0 bytes; a null key hashes as the empty string; one row larger than the limit gets a
shard of its own (nothing smaller exists), be its text ever so long: texts are one number from the first pass on; repeated
rows are rows of one key; rows of one key are paged in the order of the stored table, which is no order of their own, so
between runs they may swap pages; an empty table gives no rows. Only key and text are read: extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, table, unit_hash

BITS = 60
BYTE_LIMIT = 256 * 1024
#: Bits of histogram below the depth at which an even spread would fit; a round of deeper cells adds as many.
SLACK_BITS = 6
BLOCK_ROWS = 4096


def leaves(cells: DataFrame, lo: int, hi: int, limit: int) -> DataFrame:
    """cells(cell, bytes) at depth hi, all below oversized prefixes at depth lo - 1. Returns prefix, depth, shard_bytes
    of the leaves found, and those at hi that are still above the limit."""
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, cast({hi} - depth as int))"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    # A prefix is a leaf if it fits and its parent does not: parents are one shift away, so this is an equi-join.
    big = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == hi)).withColumn("parent", F.shiftright("prefix", 1))
    first = fits.where(F.col("depth") == lo)
    return fits.where(F.col("depth") > lo).join(big, ["depth", "parent"], "left_semi").unionByName(first).select("depth", "prefix", F.col("bytes").alias("shard_bytes"))


def assign(docs: DataFrame, limit: int = BYTE_LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, depth, prefix (bits as text), page, shard_id, shard_bytes, global_depth, slot of every row of docs."""
    if limit < 1:
        raise ValueError("the byte limit must be positive")
    rows = materialise(docs.select(F.col(key).alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), unit_hash(key).alias("h")), "shard-sizes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    lo, hi, todo, found = 0, min(BITS, max(0, (int(total) // limit).bit_length() + SLACK_BITS)), rows, []
    while True:
        cells = todo.groupBy(F.shiftright("h", BITS - hi).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        at = materialise(leaves(cells, lo, hi, limit), "shard-leaves")
        over = at.where((F.col("shard_bytes") > limit) & (F.col("depth") == hi))
        if hi == BITS or over.isEmpty():
            found.append(at)
            break
        found.append(at.where((F.col("shard_bytes") <= limit) | (F.col("depth") < hi)))
        todo = todo.withColumn("prefix", F.shiftright("h", BITS - hi)).join(over.select("prefix"), "prefix", "left_semi").select(*rows.columns)
        lo, hi = hi + 1, min(BITS, hi + SLACK_BITS)
    leaf = found[0]
    for x in found[1:]:
        leaf = leaf.unionByName(x)
    depths = [r[0] for r in leaf.select("depth").distinct().collect()]  # at most 61
    # One join key for leaves of any depth: a row is probed once for each depth in use.
    probes = rows.select(key, "n_bytes", "h", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
                         F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in sorted(depths)] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))])).alias("p"))
    placed = probes.select(key, "n_bytes", "h", "file", "row", "p.*").join(leaf, ["depth", "prefix"])
    placed = paged(placed, limit) if BITS in depths and not leaf.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit)).isEmpty() else placed.withColumn("page", F.lit(0).cast("long"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select(key, "n_bytes", "depth", bits.alias("prefix"), "page", F.concat_ws("-", F.concat(F.lit("s"), bits), F.when(F.col("page") > 0, F.col("page").cast("string"))).alias("shard_id"), "shard_bytes",
                         F.lit(max(depths, default=0)).alias("global_depth"), F.shiftright("h", BITS - max(depths, default=0)).alias("slot"))


def paged(placed: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of leaves that no bit can split. page counts from 0; shard_bytes becomes the page's."""
    over = placed.where(F.col("shard_bytes") > limit).withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))
    keys = ["depth", "prefix"]
    blocks = over.groupBy(*keys, "file", "block").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most"))
    largest = blocks.groupBy(*keys).agg(F.max("most").alias("most"))
    blocks = blocks.drop("most").withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*keys, "file", "block").orderBy("row")) - 1
    over = over.withColumn("rank", rank).join(blocks, [*keys, "file", "block"]).join(largest, keys)
    over = over.withColumn("page", F.floor((F.col("rank") + F.col("before")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most")))).cast("long"))
    pages = over.groupBy(*keys, "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    over = over.drop("shard_bytes").join(pages, [*keys, "page"])
    columns = [*[c for c in placed.columns if c != "shard_bytes"], "page", "shard_bytes"]
    return placed.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long")).select(*columns).unionByName(over.select(*columns))


def directory(assigned: DataFrame) -> DataFrame:
    """first_slot, last_slot, shard_id: the directory at the global depth, a run of slots for each leaf that holds rows; of a
    leaf with overflow pages, the first page."""
    leaf = assigned.where("page = 0").select("depth", "prefix", "shard_id", "global_depth").distinct()
    at = F.coalesce(F.conv(F.when(F.col("prefix") != "", F.col("prefix")), 2, 10).cast("long"), F.lit(0).cast("long"))
    span = F.expr("shiftleft(1L, cast(global_depth - depth as int))")
    return leaf.select((at * span).alias("first_slot"), (at * span + span - 1).alias("last_slot"), "shard_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
sums AS (SELECT depth, h >> (60 - depth)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d, range(0, 61) t(depth) GROUP BY 1, 2),
leaf AS (SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1
         WHERE (s.shard_bytes <= {BYTE_LIMIT} OR s.depth = 60) AND (s.depth = 0 OR p.shard_bytes > {BYTE_LIMIT}))
SELECT d.doc_id, d.n_bytes, l.depth::INT AS depth, CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(l.prefix), 64, '0'), l.depth::INT) END AS prefix,
       0::BIGINT AS page, 's' || CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(l.prefix), 64, '0'), l.depth::INT) END AS shard_id, l.shard_bytes,
       g.depth::INT AS global_depth, d.h >> (60 - g.depth)::INT AS slot
FROM d CROSS JOIN (SELECT max(depth) AS depth FROM leaf) g JOIN leaf l ON l.prefix = d.h >> (60 - l.depth)::INT
"""
