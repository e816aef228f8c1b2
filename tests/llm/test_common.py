import os

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C


def test_tables_live_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "shared_dir", lambda s: f"file://{tmp_path}")
    df = C.materialise(spark.range(5), "x")
    at = C.tables_dir(spark).removeprefix("file://")
    assert at.startswith(str(tmp_path)) and len(os.listdir(at)) == 1 and df.count() == 5
    assert all(f.startswith(f"file://{tmp_path}") for f in df.inputFiles())
    C.release(spark)
    assert not os.listdir(at) and not C.written(spark)


def test_the_session_says_where():
    class Conf:
        def __init__(self, at):
            self.conf, self.sparkContext, self.master, self.at = self, self, "local[2]", at

        def get(self, key, default):
            return self.at if key == "spark.checkpoint.dir" and self.at else default

    assert C.shared_dir(Conf("hdfs://h/p/")) == "hdfs://h/p"
    assert C.shared_dir(Conf(None)).startswith("file:///")


def test_slices():
    b = pa.record_batch({"a": ["x" * 10] * 10 + [None, "y" * 100, ""], "n": list(range(13))})
    got = [s.num_rows for s in C.slices(b, 5, 35)]
    assert sum(got) == 13 and max(got) <= 5
    assert [s.column(1)[0].as_py() for s in C.slices(b, 5, 35)] == [sum(got[:k]) for k in range(len(got))]
    assert [s.num_rows for s in C.slices(b, 500, 1)][:3] == [1, 1, 1]


def test_unit_hash_is_md5(spark):
    import hashlib

    df = spark.createDataFrame([(1,), (None,)], "i long").select("i", C.unit_hash(F.lit("s"), "i").alias("h"))
    for r in df.collect():
        text = "s:" + ("" if r.i is None else str(r.i))
        assert r.h == int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_every_operator_survives_small_batches(spark: SparkSession):
    df = spark.createDataFrame([(i, "t" * i) for i in range(20)], "i long, t string")
    got = C.map_batches(df, lambda: lambda b: {"n": [len(b["i"])] * len(b["i"])}, "n int", rows=3).collect()
    assert len(got) == 20 and max(r.n for r in got) <= 3


def test_nested_rows_are_sliced_by_bytes():
    rows = pa.array([[{"x": b"a" * 1000}] * 1000] * 8, pa.list_(pa.struct([("x", pa.binary())])))
    batch = pa.RecordBatch.from_arrays([rows], names=["rows"])
    assert max(p.num_rows for p in C.slices(batch, 100, 2_000_000)) <= 2


def test_no_shared_folder_off_local_mode(spark):
    class Other:
        conf = spark.conf

        class sparkContext:
            master = "spark://host:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            C.shared_dir(Other())
    assert C.shared_dir(spark)


def test_released_tables_are_gone(spark):
    begun = len(C.written(spark))
    a, b = C.materialise(spark.range(3), "a"), C.materialise(spark.range(4), "b")
    C.release(spark, C.written(spark)[begun:-1])
    assert b.count() == 4 and len(C.written(spark)) == begun + 1


def test_broadcast_goes_by_the_size_of_rows(spark, tmp_path, monkeypatch):
    """A column of one value is a small file of large rows: planner and operator must not send it to every executor."""
    monkeypatch.setattr(C, "shared_dir", lambda s: f"file://{tmp_path}")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    few = C.materialise(spark.range(10).select("id", F.lit("x").alias("t")), "few")
    many = C.materialise(spark.range(20_000).select("id", F.lit("y" * 100).alias("t"), F.array(F.lit("z" * 50)).alias("a")), "many")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    big = C.materialise(spark.range(200_000).select((F.col("id") % 20_000).alias("id"), F.xxhash64("id").alias("v")), "big")
    try:
        spark.conf.set(name, str(1 << 20))
        stored = sum(f.stat().st_size for f in tmp_path.rglob("many-*/*.parquet"))
        assert stored < 1 << 20 and "BroadcastHashJoin" in plan(big.join(many, "id"))
        joined = big.join(C.sized(many), "id")
        assert "SortMergeJoin" in plan(joined) and joined.count() == 200_000
        assert "BroadcastHashJoin" in plan(big.join(C.sized(few), "id"))
        assert "SortMergeJoin" in plan(big.join(C.sized(many).select("id", F.lit(1).alias("one")), "id", "left_semi"))
        spark.conf.set(name, "-1")
        assert C.sized(many) is many
    finally:
        spark.conf.set(name, before)
        C.release(spark)


def test_stages_keep_dotted_names_and_refuse_text_ids(spark):
    import pytest

    from quarry.llm import mixing, quality_rules, setsketch

    text = " ".join(f"word{i} and more of this sentence, which runs on." for i in range(40))
    rows = [(1, text, "a", "x"), (1, text, "b", "y"), (2, text, "a", "z"), (None, None, None, None), (None, "one two", "a", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `meta.lang` string")
    kept = setsketch.keep_one(df)
    assert kept.columns == df.columns
    want = [(1, text, "a", "x"), (None, None, None, None), (None, "one two", "a", "n")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert {r[3] for r in quality_rules.keep(df).collect()} <= {"x", "y", "z"}
    mixed = mixing.repeat(df)
    assert mixed.columns == df.columns and mixed.where("`meta.lang` IS NULL").count() == 0
    with pytest.raises(ValueError, match="integer"):
        setsketch.keep_one(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_rows_without_a_key_are_mixed_one_by_one(spark):
    from quarry.llm import mixing

    df = spark.createDataFrame([(None, f"w{i} w w w", "s") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.repeat(df).groupBy("text").count().collect()
    assert abs(sum(r["count"] for r in got) - 450) <= 1 and {r["count"] for r in got} == {1, 2}
