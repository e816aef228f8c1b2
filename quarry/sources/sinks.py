"""Where results go: reports, answers, discarded content, and files of a generated corpus."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.content import report_line, summary, summary_line
from quarry.operators.hits import envelope


def discard(df: DataFrame) -> None:
    """Read everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def report(results: DataFrame, path: str) -> None:
    """One line for each row, in order of pos, and a summary line last, as text files below path."""
    lines = results.select(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), report_line().alias("value"))
    last = summary_line(summary(results)).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("line").alias("value"))
    lines.unionAll(last).repartitionByRange("part", "pos").sortWithinPartitions("part", "pos").select("value").write.mode("overwrite").text(path)


def answer(hits: DataFrame, path: str) -> None:
    envelope(hits).write.mode("overwrite").text(path)


def write_corpus(files: dict[str, bytes], folder: str) -> None:
    """A few named payloads as files, from the driver: a fixture, so small by definition. Names may hold folders."""
    for name, content in files.items():
        at = Path(folder) / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def error_body(code, message, key: str = "error"):
    """The JSON of an error answer, null for codes below 400."""
    return F.when(F.col(code) >= 400, F.to_json(F.struct(F.col(message).alias(key))))
