"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space; bytes.split() splits on the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode (tests), where the session may name none, is it one of
    this process: a cluster's machines don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/quarry-shared-{os.getpid()}"
    return at.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"


_written: dict[str, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    """The paths that materialise() has written for this application, oldest first."""
    return _written.setdefault(spark.sparkContext.applicationId, [])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor costs no rerun
    of what came before. The path is new on each call; release() deletes such tables."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """df, a written table that a join may broadcast, kept from it if its rows take more than the session's threshold. The
    planner goes by the size of the files, which are compressed. Where that leaves room for doubt (above an eighth of a
    percent of the threshold), one aggregate counts rows and bytes of texts, binaries and arrays."""
    plan = df._jdf.queryExecution().optimizedPlan()
    limit, stored = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), int(str(plan.stats().sizeInBytes()))
    if not limit / 800 < stored <= limit:
        return df
    bytes_, width = [F.lit(0)], 16 + 8 * len(df.columns)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            bytes_.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            bytes_.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)))
    taken = df.agg(F.coalesce(F.sum(sum(bytes_[1:], bytes_[0]) + F.lit(width)), F.lit(0)).cast("long")).first()[0]
    return df.hint("merge") if taken > limit else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has as columns (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as it stands in SQL: a dot in it is no path."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame) -> list:
    return [F.col(quoted(c)) for c in df.columns]


def as_row(df: DataFrame, name: str, *more) -> DataFrame:
    """df's columns in one struct, beside others: a join that names its columns trips over dots in the rest."""
    return df.select(*more, F.struct(*every(df)).alias(name))


def fields(row: str, columns: list[str]) -> list:
    return [F.col(row).getField(c).alias(c) for c in columns]


def integral(df: DataFrame, key: str) -> None:
    """Operators whose results go by the order of ids take integers only."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer, not {kind}: number the rows first, in the order in which they are to win")


def unit_hash(*cols) -> F.Column:
    """A 60-bit hash, as a long, that SQL engines with md5 can repeat: the first 15 hex digits of md5 of the parts
    joined by ':'. A null part counts as the empty string."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


#: Polynomial hashes of byte ranges: prefix sums over powers of ODD, shifted back by powers of its inverse, then mixed.
ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, ODD), (1, _INVERSE)):
            a = np.full(max(n, 1 << 20), base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


#: Documents that cross to Python at once, and bytes of text that are worked on at once: long texts may lie together, and
#: a text's words take many times its size in Python.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package once to the executors of an application, by the shared folder: their disks are their own."""
    if spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parents[2]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted((root / "quarry").rglob("*.py")):
            z.write(f, f.relative_to(root))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tables_dir(spark)}/code-{uuid.uuid4().hex}/quarry.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())


def prepare_python(spark: SparkSession) -> None:
    """Before Python runs on executors: the code is there, and batches are small. Spark reads the batch size from the session
    when a result is computed, which may be after the operator returned it, so the setting stays; a smaller one wins."""
    _ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return free memory to the system at the end of a task: workers are reused, and what one operator's arrays leave in
    the allocators would add to what the next one takes."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batch, rows: int, size: int = BATCH_BYTES):
    """A batch in slices of at most `rows` rows and, but for single rows, about `size` bytes of texts, binaries and arrays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type) and len(c.flatten()):
            total += pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) * (c.flatten().nbytes // len(c.flatten()) + 1)
    upto = np.cumsum(total)
    lo = 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_batches(df: DataFrame, make, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with small batches. make() runs once in each task and returns a function from a dict of lists, one per
    column of df, to a dict of lists, one per column of schema. It sees slices() of batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    prepare_python(df.sparkSession)
    out, columns = to_arrow_schema(StructType.fromDDL(schema)), df.columns

    def run(batches):
        f = None
        for b in batches:
            f = f or make()
            for part in slices(b, rows):
                got = f({n: c.to_pylist() for n, c in zip(columns, part.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)
        f = None
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, schema)  # it trips over dots in names


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these tables, or all that materialise() wrote for this application, once no result that reads them is needed
    any more. The shipped code stays: executors that come later fetch it. Spark deletes shuffle files when the driver's
    collector finds their plans gone, which may be long after; it is asked to look now."""
    gone = list(written(spark) if paths is None else paths)
    for at in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[spark.sparkContext.applicationId] = [p for p in written(spark) if p not in set(gone)]
    gc.collect()
    spark.sparkContext._jvm.System.gc()
