from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import sharding as S


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(rows, limit):
    sizes = Counter()
    most = Counter()
    for r in rows:
        sizes[r.shard_id] += r.n_bytes
        most[r.shard_id] += 1
    for r in rows:
        assert sizes[r.shard_id] == r.shard_bytes
        assert r.shard_bytes <= limit or most[r.shard_id] == 1
    return sizes


def test_every_shard_fits_and_only_large_buckets_split(spark):
    got = S.assign(docs(spark, [(i, "x" * (i % 97)) for i in range(2000)]), limit=1500).collect()
    assert len(got) == 2000
    sizes = check(got, 1500)
    leaves = {r.prefix: r.shard_bytes for r in got}
    for p in leaves:  # the parent of a leaf was too large, and no leaf lies in another
        inside = sum(b for q, b in leaves.items() if q.startswith(p[:-1]))
        assert not p or inside > 1500
        assert not any(q != p and q.startswith(p) for q in leaves)
    assert len(sizes) == len(leaves)
    d = S.directory(S.assign(docs(spark, [(i, "x" * (i % 97)) for i in range(2000)]), limit=1500))
    depth = max(len(p) for p in leaves)
    runs = sorted(map(tuple, d.collect()))
    assert runs[0][0] == 0 and runs[-1][1] == 2**depth - 1 and all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:]))
    find = lambda slot: next(s for lo, hi, s in runs if lo <= slot <= hi)
    assert all(r.global_depth == depth and find(r.slot) == r.shard_id for r in got)


def test_a_directory_of_full_depth(spark):
    """One id with more bytes than fit: no bit splits it, and the directory is 60 bits deep."""
    a = S.assign(docs(spark, [(7, "y" * 40)] * 50 + [(i, "x") for i in range(20)]), limit=100)
    assert {r.global_depth for r in a.select("global_depth").collect()} == {60}
    runs = sorted(map(tuple, S.directory(a).collect()))
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:])) and runs[-1][1] < 2**60


def test_one_shard_if_all_fits(spark):
    got = S.assign(docs(spark, [(1, "a"), (2, None), (None, "é")]), limit=100).collect()
    assert {(r.depth, r.shard_id, r.shard_bytes) for r in got} == {(0, "s", 3)}


def test_one_key_with_a_third_of_all_rows(spark):
    rows = [(7, "y" * 40)] * 500 + [(i, "x" * 30) for i in range(1000, 2000)]
    got = S.assign(docs(spark, rows).repartition(3), limit=1000).collect()
    assert len(got) == 1500
    check(got, 1000)
    assert len({r.shard_id for r in got if r.doc_id == 7}) >= 20


def test_a_row_above_the_limit_is_alone(spark):
    got = S.assign(docs(spark, [(1, "x" * 500), (2, "y"), (3, "z" * 500)]), limit=100).collect()
    check(got, 100)


def test_empty_and_extra_columns(spark):
    assert S.assign(docs(spark, []), limit=10).count() == 0
    df = docs(spark, [(1, "a")]).withColumn("n_bytes", F.lit(9)).withColumn("prefix", F.lit("p"))
    assert S.assign(df, limit=10).first().n_bytes == 1
