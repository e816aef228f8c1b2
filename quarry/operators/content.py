"""User-scoped content scans: a verdict for each request, blocks, and the run's summary.

No row fails the job: what went wrong is a status. Order is the requests' own `pos`, duplicates are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ, NOT_ACCESSIBLE, ERROR = "read", "not-accessible", "error"
BLOCK = 65_536


def content_read(requests: DataFrame, files: DataFrame) -> DataFrame:
    """All columns of requests(user_id, file_id, ...) with status, bytes_read and detail. files(user_id, file_id,
    http_status, content) has one row a key; no row, 404 and 998 mean not accessible, other codes from 400 an error with
    no bytes, and anything else counts the content as read, redirects included. Where files has a column failure, a name
    there is a transfer that broke off for that reason: an error, whatever the code. detail names the reason. Where it has a
    column n_bytes, bodies were counted when they passed, and content is not read."""
    failure = F.col("failure") if "failure" in files.columns else F.lit(None).cast("string")
    f = files.select("user_id", "file_id", F.when(failure.isNull(), F.col("http_status")).otherwise(599).alias("http_status"), (F.col("n_bytes") if "n_bytes" in files.columns else F.octet_length("content")).cast("long").alias("_n"), failure.alias("_failure"))
    code = F.col("http_status")
    status = F.when(code.isNull() | code.isin(404, 998), NOT_ACCESSIBLE).when(code >= 400, ERROR).otherwise(READ)
    out = requests.join(f, ["user_id", "file_id"], "left").withColumn("status", status)
    out = out.withColumn("bytes_read", F.when(F.col("status") == READ, F.coalesce("_n", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    return out.withColumn("detail", F.when(F.col("status") == ERROR, F.coalesce("_failure", F.lit("HTTPStatusError"))).otherwise("")).select(*requests.columns, "status", "bytes_read", "detail")


def gateway_verdict(requests: DataFrame, nodes: DataFrame, backend: str) -> DataFrame:
    """All columns of requests(caller, user_id, file_id, ...) with code: 403 for a foreign caller, before any lookup; 404
    for no user, no id, nothing visible or no file; 422 if it can't be opened; 500 for another failure; else 200.
    nodes(user_id, file_id, is_file, opens, fails) has one row a key."""
    n = nodes.select("user_id", "file_id", "is_file", "opens", "fails", F.lit(True).alias("_known"))
    own = requests.where(F.col("caller") == backend).join(n, ["user_id", "file_id"], "left")
    code = F.when(F.col("_known").isNull() | ~F.col("is_file"), 404).when(~F.col("opens"), 422).when(F.col("fails"), 500).otherwise(200)
    foreign = requests.where(~F.col("caller").eqNullSafe(backend))
    return own.select(*requests.columns, code.alias("code")).unionByName(foreign.withColumn("code", F.lit(403)))


def content_blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """file_id, block_no, block_bytes, running_bytes, block of every block of content. Empty content has none."""
    n = F.octet_length("content")
    blocks = files.where(n > 0).select("file_id", F.col("content").cast("binary").alias("_c"), n.cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("block_no"))
    end = F.least(F.col("_n"), (F.col("block_no") + 1).cast("long") * size)
    return blocks.select("file_id", "block_no", (end - F.col("block_no").cast("long") * size).alias("block_bytes"), end.alias("running_bytes"), F.substring("_c", F.col("block_no") * size + 1, F.lit(size)).alias("block"))


def report_line(file_id="file_id", status="status", bytes_read="bytes_read", detail="detail"):
    tail = F.when(F.coalesce(F.col(detail), F.lit("")) != "", F.concat(F.lit(" detail="), F.col(detail))).otherwise("")
    return F.concat(F.lit("file "), F.col(file_id).cast("string"), F.lit(" "), F.col(status), F.lit(" bytes="), F.col(bytes_read).cast("string"), tail)


def status_counts(results: DataFrame) -> DataFrame:
    """status, n of all three statuses, zeros included."""
    all_ = results.sparkSession.createDataFrame([(READ,), (NOT_ACCESSIBLE,), (ERROR,)], "status string")
    return all_.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """One row: files, read, not_accessible, error, bytes. No rows give zeros."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("files"), count(READ).alias("read"), count(NOT_ACCESSIBLE).alias("not_accessible"), count(ERROR).alias("error"), F.coalesce(F.sum("bytes_read"), F.lit(0).cast("long")).alias("bytes"))


def summary_line(s: DataFrame) -> DataFrame:
    parts = [F.lit("summary files="), F.col("files"), F.lit(" read="), F.col("read"), F.lit(" not-accessible="), F.col("not_accessible"), F.lit(" error="), F.col("error"), F.lit(" bytes="), F.col("bytes")]
    return s.select(F.concat(*[p.cast("string") for p in parts]).alias("line"))


def exit_code(results: DataFrame) -> DataFrame:
    """One row: 1 if any row is an error, else 0, also for no rows."""
    return results.agg(F.when(F.coalesce(F.bool_or(F.col("status") == ERROR), F.lit(False)), 1).otherwise(0).alias("exit_code"))
