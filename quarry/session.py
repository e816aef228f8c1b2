"""Session defaults. A cluster's own settings win; these fill what is unset."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config(map={**DEFAULTS, **conf})
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, for what is written on the way to a result. Only where
    driver and executors are one machine, and the session names no folder, is it a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/quarry-shared-{os.getpid()}"
    return f"{at.rstrip('/')}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows, and bytes, that cross to Python at once where rows are whole files.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what crosses to Python at once by bytes too, where Spark can. Spark reads both settings when a result is computed, which
    may be after a query returned it, so they stay; smaller ones win."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", (spark.conf.get(name) if name.endswith("RecordsPerBatch") else spark.conf.get(name, str(2**31 - 2))).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))
