"""Files of a corpus as a data source with commit.

write(df(name, content), folder) writes each row as a file, with a manifest of paths, sizes and digests, and the totals. A
task writes below a staging folder of its own and lists its files there; the driver gets a folder's name and two sums from each
task, moves the folders of the tasks that count in place (one rename a task, whatever its files) and writes _TOTAL last. A
task that fails removes what it wrote, an aborted job everything; attempts that Spark ran twice stay behind in staging and go
with it. Names may hold folders, but lead nowhere else; of two rows of one name in a task the later would overwrite the former,
so that is an error. The folder must be a mounted one that all executors share (file:// or a plain path), and new.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "path string, bytes long, sha256 string"


def local(folder: str) -> str:
    at = folder.removeprefix("file://")
    if "://" in at:
        raise ValueError(f"{folder} is no mounted folder")
    return at


@dataclass
class Written(WriterCommitMessage):
    staged: str
    files: int
    bytes: int


class CorpusWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = local(folder)
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")
        os.makedirs(self.staging)  # by the driver: a task that is still on its way when the job is aborted finds it gone

    def write(self, rows):
        at = os.path.join(self.staging, uuid.uuid4().hex)
        os.mkdir(at)
        os.mkdir(os.path.join(at, "files"))
        n = total = 0
        try:
            with open(os.path.join(at, "manifest"), "w") as listed:
                for name, content in rows:
                    content = bytes(content or b"")
                    parts = (name or "").split("/")
                    if not name or any(p in ("", ".", "..") for p in parts):
                        raise ValueError(f"{name!r} is no name of a file")
                    path = os.path.join(at, "files", *parts)
                    if len(parts) > 1:
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "xb") as f:
                        f.write(content)
                    listed.write(json.dumps({"name": name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}) + "\n")
                    n, total = n + 1, total + len(content)
        except BaseException:
            shutil.rmtree(at, ignore_errors=True)
            raise
        return Written(at, n, total)

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        os.makedirs(os.path.join(self.folder, "_manifest"), exist_ok=True)
        for k, m in enumerate(done):
            if m.files:
                os.replace(os.path.join(m.staged, "files"), os.path.join(self.folder, f"part-{k:05d}"))
                os.replace(os.path.join(m.staged, "manifest"), os.path.join(self.folder, "_manifest", f"part-{k:05d}.json"))
        shutil.rmtree(self.staging, ignore_errors=True)
        with open(os.path.join(self.folder, "_TOTAL"), "w") as f:
            json.dump({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}, f)

    def abort(self, messages):
        gone = f"{self.staging}-gone"
        os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class CorpusSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def writer(self, schema, overwrite) -> CorpusWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("a corpus is written from the columns name and content")
        return CorpusWriter(self.options["path"])


def write(df: DataFrame, folder: str) -> str:
    at = local(folder)
    if os.path.exists(os.path.join(at, "_TOTAL")):
        raise FileExistsError(f"{folder} holds a corpus")
    df.sparkSession.dataSource.register(CorpusSink)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format("corpus").mode("append").save(at)
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (below folder), bytes, sha256 of every committed file."""
    at = local(folder)
    if not os.path.exists(os.path.join(at, "_TOTAL")):
        raise FileNotFoundError(f"{folder} holds no complete corpus")
    rows = spark.read.schema("name string, bytes long, sha256 string").option("recursiveFileLookup", "true").json(f"file://{at}/_manifest/*.json") if os.listdir(os.path.join(at, "_manifest")) else spark.createDataFrame([], "name string, bytes long, sha256 string")
    if "_metadata" in rows.columns or rows.inputFiles():
        part = F.regexp_extract(F.col("_metadata.file_path"), r"(part-\d+)\.json$", 1)
        return rows.select(F.concat(part, F.lit("/"), "name").alias("path"), "bytes", "sha256")
    return rows.select(F.col("name").alias("path"), "bytes", "sha256")
