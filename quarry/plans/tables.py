"""Input tables, and the relations that the operators read them as.

A document is a file: doc_id is its id, source its owner, text its content. labels is a second visibility set; events are
requests; page URLs stand for routes and base URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, file_id, http_status, content: what the storage answers for each file. A toxic label stands for a server
    error, a low quality label for the storage's own not-accessible code."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("toxic") == 1, 500).when(F.col("quality") == 0, 998).otherwise(200)
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), status.alias("http_status"), F.col("text").alias("content"))


FILES_SQL = """files AS (SELECT d.source AS user_id, d.doc_id AS file_id,
    CASE WHEN l.toxic = 1 THEN 500 WHEN l.quality = 0 THEN 998 ELSE 200 END AS http_status, d.text AS content
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, file_id: every owner asks for each own file, user src1 for all files, and for 20 ids that nobody has."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"))
    all_ = docs.select(F.lit("src1").alias("user_id"), F.col("doc_id").alias("file_id"))
    unknown = spark.range(1, 21).select(F.lit("src1").alias("user_id"), (-F.col("id")).alias("file_id"))
    return own.unionAll(all_).unionAll(unknown)


REQUESTS_SQL = """requests AS (SELECT source AS user_id, doc_id AS file_id FROM documents
  UNION ALL SELECT 'src1', doc_id FROM documents UNION ALL SELECT 'src1', -r FROM range(1, 21) t(r))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, file_id, name, path: labelled documents, seen by their owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    name = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    return docs.join(labels, "doc_id").select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), name.alias("name"), F.concat(F.lit("/"), "lang", F.lit("/"), name).alias("path"))


NODES_SQL = """nodes AS (SELECT d.source AS user_id, d.doc_id AS file_id, 'document ' || d.doc_id AS name,
    '/' || d.lang || '/document ' || d.doc_id AS path FROM documents d JOIN labels l USING (doc_id))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, file_id, title, snippet: an answer that holds every document, in order of id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("file_id"), F.lit("from the answer").alias("title"), F.col("text").alias("snippet"))


HITS_SQL = "hits AS (SELECT source AS user_id, doc_id AS pos, doc_id AS file_id, 'from the answer' AS title, text AS snippet FROM documents)"
