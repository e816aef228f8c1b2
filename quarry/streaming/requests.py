"""An unbounded request log through the same operators (an extension: the batch semantics define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.requests import validated


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def verdict_counts(log: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """start, code, n of log(ts, body, user), by windows of event time. Rows later than delay are not counted."""
    v = validated(log.select(F.col("ts").cast("timestamp").alias("ts"), "body", "user")).withWatermark("ts", delay)
    return v.groupBy(F.window("ts", width), "code").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "code", "n")
