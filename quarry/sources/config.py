"""Configuration as a relation: one row a deployment, normalised by column expressions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.functions import text as X

COLUMNS = ("log_level", "tunnel_key", "port", "socket", "host", "tls", "timeout")


def from_environment(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """One row of COLUMNS from environment variables; names says which variable holds which column."""
    return spark.createDataFrame([tuple(os.environ.get(names[c]) if c in names else None for c in COLUMNS)], ", ".join(f"{c} string" for c in COLUMNS))


def normalised(config: DataFrame) -> DataFrame:
    """log_level, problem, binding, tls, timeout; columns that are no settings stay."""
    rest = [c for c in config.columns if c not in COLUMNS]
    return config.select(*rest, X.log_level("log_level").alias("log_level"), X.startup_problem("tunnel_key", "port").alias("problem"), X.binding("tunnel_key", "socket", "host", "port").alias("binding"), X.tls_setting("tls").alias("tls"), X.timeout_seconds("timeout").alias("timeout"))
