"""python -m quarry.cli --user-id U [--ids-file F] [ID ...] --tables DIR: read files as a user and report.

Exit code 0: every file was read or is not accessible; 1: some file failed; 2: the call itself is wrong. DIR holds the
tables that quarry.plans.tables reads as files.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quarry.operators import content
from quarry.plans import tables
from quarry.session import session
from quarry.sources import ids


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="quarry.cli")
    p.add_argument("file_ids", nargs="*", type=int)
    p.add_argument("--ids-file")
    p.add_argument("--user-id", required=True)
    p.add_argument("--tables", required=True)
    a = p.parse_args(args)
    if a.ids_file and not os.path.isfile(a.ids_file):
        p.error(f"no such file: {a.ids_file}")
    spark = spark or session()
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate(a.file_ids)], "pos long, file_id long")
    if a.ids_file:
        parsed = ids.read(spark, a.ids_file)
        wrong = ids.first_errors(parsed).first()
        if wrong:
            p.error(f"entry {wrong['entry']} of {a.ids_file} is no file id")
        wanted = ids.union(wanted, parsed).select((F.col("part") * (1 << 40) + F.col("pos")).alias("pos"), "file_id")
    if wanted.isEmpty():
        p.error("no file ids")
    results = content.content_read(wanted.withColumn("user_id", F.lit(a.user_id)), tables.files(spark, a.tables))
    results = results.persist(StorageLevel.DISK_ONLY)  # read once for the lines, the summary and the code
    for line in results.orderBy("pos").select(content.report_line().alias("line")).toLocalIterator():
        print(line["line"])
    print(content.summary_line(content.summary(results)).first()["line"])
    code = content.exit_code(results).first()["exit_code"]
    results.unpersist()
    return code


if __name__ == "__main__":
    sys.exit(main())
