"""Id lists: files of white-space separated positive integers, and ids given inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import SPACES


def parse(files: DataFrame) -> DataFrame:
    """name, pos (from 1), token, file_id of each token of files(name, content); file_id is null where the token is no
    positive integer of ASCII digits that fits 64 bits."""
    text = F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    t = files.select("name", F.posexplode(F.split(text, f"[{SPACES}]+")).alias("pos", "token")).where("token <> ''")
    number = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("bigint"))
    return t.select("name", (F.col("pos") + 1).alias("pos"), "token", F.when(number > 0, number).alias("file_id"))


def first_errors(parsed: DataFrame) -> DataFrame:
    """name, entry: the position of the first token of a file that is no id."""
    return parsed.where("file_id IS NULL").groupBy("name").agg(F.min("pos").alias("entry"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The tokens of text files."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("content")))


def union(inline: DataFrame, from_files: DataFrame) -> DataFrame:
    """part, pos, file_id: inline ids, then those of files; order and duplicates stay. Both have pos and file_id."""
    return inline.select(F.lit(0).alias("part"), "pos", "file_id").unionAll(from_files.select(F.lit(1).alias("part"), "pos", "file_id"))
