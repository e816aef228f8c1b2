"""Mixing sources to target weights (native: DataFrame functions only).

Method: capped water-filling. Every source gets weight * level words, but never more than `max_epochs` times its size;
what a capped source can't take is reshared by weight among the others until none is above its cap. With the sources
ordered by cap / weight the capped ones are a prefix, so the fixed point of that resharing is read off two running
sums over one row per source. Then each source takes floor(target / size) whole repetitions of all its documents and one
fractional repetition: its documents in a seeded random order up to the words still wanted.

The order is not materialised: a 2**BUCKET_BITS-bucket histogram of the seeded hash gives, per source, the bucket in
which the wanted words are reached; only that bucket's documents are ordered in a window. A source with a third of all
rows therefore costs partial sums, and 1 / 4096 of its rows in one window.

Defined results: null or empty text has size 0 and is never taken beyond 0 words; a null source is a source of its own,
ordered last; repeated rows count each, and null keys share one hash; equal hashes are ordered by key, then size; sources
whose caps tie fill in order of name; an empty table gives no rows. A very long text is one number from the first pass on.
mix() reads key, source and text and returns only its own columns, so extra columns may have any name; repeat() returns
the columns of docs whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, as_row, fields, materialise, quoted, table, unit_hash

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKET_BITS = 12


def word_count(col: str = "text") -> F.Column:
    return F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of every source of sizes(source, size). One row per source, so its windows run over
    as many rows as there are sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    n = len(weights)
    k = F.pmod(F.row_number().over(order) - 1, F.lit(n))
    w = F.lit(weights[-1]).cast("double")
    for i in reversed(range(n - 1)):
        w = F.when(k == i, F.lit(float(weights[i]))).otherwise(w)
    by = by.select("source", "source_size", w.alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    by = by.withColumn("level", (F.sum("source_size").over(whole) * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).withColumn("turn", F.row_number().over(fill))
    # The first source, in that order, whose share at its own level is within its cap sets the level of all after it.
    by = by.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole)["level"])
    return by.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("open") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, size: F.Column | None = None, key: str = "doc_id", seed: str = SEED, **targets) -> DataFrame:
    """The rows of docs with size, source_size, target, whole (full repetitions), extra (words of the fractional
    repetition) and taken = whole * size + extra. Only key, source and size are kept of docs; join on key for more."""
    sized = docs.select(F.col(key), F.col("source"), (word_count() if size is None else size).alias("size"))
    sized = materialise(sized.withColumn("u", unit_hash(F.lit(seed), key)), "mix-sizes")
    by = source_targets(sized, **targets)
    by = by.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    by = materialise(by.withColumn("want", F.greatest(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0).cast("long"))), "mix-targets")
    bucket = F.shiftright("u", 60 - BUCKET_BITS).cast("int")
    sized = sized.withColumn("bucket", bucket)
    run = Window.partitionBy("source").orderBy("bucket")
    hist = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("upto", F.sum("in_bucket").over(run))
    cut = hist.alias("h").join(by.alias("t"), F.expr("h.source <=> t.source")).where("upto >= want").groupBy("t.source").agg(
        F.min_by(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before")), "bucket").alias("c"))
    by = by.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left").select("t.*", F.coalesce("c.c.bucket", F.lit(1 << BUCKET_BITS)).alias("cut"), F.coalesce("c.c.before", F.lit(0).cast("long")).alias("before"))
    by = materialise(by, "mix-cuts")  # its size is then known: one row a source is broadcast if it is small, sorted if not
    rows = sized.alias("d").join(by.alias("t"), F.expr("d.source <=> t.source")).select(F.col(f"d.{key}").alias(key), "d.source", "size", "source_size", "target", "whole", "want", "before", "cut", "bucket", "u")
    earlier = Window.partitionBy("source").orderBy("u", F.col(key).asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("bucket = cut").withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("want") - F.col("before") - F.coalesce(F.sum("size").over(earlier), F.lit(0)))))
    rest = rows.where("bucket <> cut").withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    return edge.unionByName(rest).select(key, "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs, each row as often as the mix takes it: the document at the edge of a fractional repetition is taken whole
    if at least half of it is wanted, so texts stay whole. Columns as in docs. Rows without a key go by their text. Rows of
    one key (or text) can't be told apart: each comes as often as the one of them that is taken most."""
    k, n = "key", "times"
    named = F.coalesce(F.col(quoted(key)).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    plan = mix(docs.select(named.alias(k), "source", "text"), key=k, **options).select(k, (F.col("whole") + (F.col("extra") * 2 >= F.greatest("size", F.lit(1))).cast("long")).alias(n)).where(F.col(n) > 0)
    plan = plan.groupBy(k).agg(F.max(n).alias(n))  # one row a key: repeated rows of docs don't multiply
    taken = as_row(docs, "row", named.alias(k)).join(plan, k)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*fields("row", docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM documents),
by0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
by1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
               (source_size * {MAX_EPOCHS})::DOUBLE AS cap FROM by0),
by2 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * {TOTAL_SHARE}::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn FROM by1),
by3 AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, turn) FROM by2 WHERE level * weight <= cap) * weight) AS t, cap FROM by2),
by4 AS (SELECT source, source_size, coalesce(t, cap) AS target FROM by3),
by5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM by4),
runs AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.whole, greatest(round(b.target)::BIGINT - b.whole * b.source_size, 0) AS want,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized d JOIN by5 b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (whole * size + greatest(0, least(size, want - before)))::BIGINT AS taken FROM runs
"""
