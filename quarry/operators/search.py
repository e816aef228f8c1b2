"""Full-text search, an extension: the engine's inputs name ranking and highlights but define neither.

Tokens are the lower-cased maximal runs of letters. Scores are BM25 with K1 and B. Highlights are 0-based half-open code
point offsets of non-overlapping occurrences, leftmost first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import small_batches

K1, B = 1.2, 0.75
TOKEN = r"\p{L}+"


def tokens(text: str = "text"):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def search(docs: DataFrame, terms: list[str], k: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (rounded to 6 places) of the k best documents with a key; ties go to the smaller key. Texts are read and
    split once: what is left of a document, its length and its counts of the query's terms, feeds both the corpus
    statistics, which are one row, and the scores, from one exchange (rows without a term go by their score, behind the join
    with the statistics: a filter on counts would move below the exchange and make it two)."""
    terms = sorted({t.lower() for t in terms})
    counts = [(F.size("t") - F.size(F.array_remove("t", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), tokens(text).alias("t")).select("key", F.size("t").alias("len"), *counts).repartition("key")
    stats = rows.agg(F.count("key").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))))).otherwise(0.0)
    scored = rows.crossJoin(F.broadcast(stats)).select("key", score.alias("score")).where("score > 0")  # stats is one row
    return scored.groupBy(F.col("key").alias(key)).agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text in Unicode form NFC, so that letters written with combining marks are found as such."""
    import unicodedata

    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [None if t is None else unicodedata.normalize("NFC", t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, text])

    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {text} string")


def highlights(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end of each occurrence, case folded where that keeps the length."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    fold = F.when(F.length(low) == F.length(F.coalesce(F.col(text), F.lit(""))), low).otherwise(F.col(text))
    quoted = "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in term.lower())
    parts = docs.where(F.contains(fold, F.lit(term.lower()))).select(key, F.posexplode(F.split(fold, quoted, -1))).select(key, "pos", F.length("col").alias("n"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = len(term)
    at = parts.withColumn("start", (F.sum("n").over(before) + F.col("pos") * size).cast("int")).withColumn("last", F.max("pos").over(Window.partitionBy(key)))
    return at.where("pos < last").select(key, "start", (F.col("start") + size).cast("int").alias("end"))
