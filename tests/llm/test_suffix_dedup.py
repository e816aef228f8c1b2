import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import suffix_dedup as S

L = S.LENGTH


def brute(rows):
    """n_bytes, n_removed, n_spans, kept_sha256 by the rule itself."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - L + 1):
            first[b[s : s + L]] = min(first.get(b[s : s + L], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - L + 1):
            if first[b[s : s + L]] < i:
                gone[s : s + L] = True
        out.append((i, len(b), int(gone.sum()), len(S.intervals(gone)), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeats(df).collect())


def corpus(seed, alphabet, n=80):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(k) for k in (L - 1, L, L + 1, 80, 300)]
    rows = []
    for i in range(n):
        parts = [rng.choice([text(rng.randrange(120)), rng.choice(shared), rng.choice(shared)[rng.randrange(10) :]]) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(parts)))
    rows += [(n + i, rng.choice(rows)[1]) for i in range(10)]
    rng.shuffle(rows)
    return rows


def test_random_text(spark):
    rows = corpus(1, "abcdefghij éß")
    assert result(spark, rows) == brute(rows)


def test_periodic_text(spark):
    rows = corpus(2, "ab", 40) + [(900, "ab" * 200), (901, "ba" * 77), (902, "a" * 400), (903, "a" * 49), (904, "a" * 50)]
    assert result(spark, rows) == brute(rows)


def test_small_chunks(spark, monkeypatch):
    """Documents of one passage in different chunks and blocks."""
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "OFTEN", 2)
    monkeypatch.setattr(S, "BLOCK", 1000)
    rows = corpus(3, "abcdefghijklmnop ")
    texts = [t.encode() for _, t in rows]
    a, b = S.runs(texts), S.runs_in_blocks(texts)
    assert all((a[k] == b[k]).all() for k in a)
    monkeypatch.setattr(S, "BLOCK", 100)  # now most texts are long ones, in pieces
    assert len(S.runs_in_blocks(texts)["doc"]) > len(b["doc"])
    assert result(spark, rows) == brute(rows)


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1000)
    rows = corpus(11, "abcdefgh ")
    assert result(spark, rows) == brute(rows)


def test_hot_anchors_at_full_size(spark):
    """A passage in all of 110,000 documents, with the constants as they are."""
    line = "this passage of more than fifty bytes stands in every document of the table"
    df = spark.range(110_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(line), F.xxhash64("id").cast("string")).alias("text"))
    assert len(S.hot_anchors(df.select(F.col("text").alias("_text")))) > 0
    got = S.repeats(df).groupBy("n_spans").agg(F.count("*").alias("n"), F.min("n_removed").alias("least"), F.min("doc_id").alias("first")).collect()
    # A byte or two beside the passage may agree as well.
    assert {r.n_spans: r.n for r in got} == {0: 1, 1: 109_999}
    assert all(r.first == 0 if r.n_spans == 0 else r.least == len(line) for r in got)


def test_a_text_of_many_megabytes(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3_000_000))
    rows = [(1, long), (2, "x" + long[1000:2_500_000] + "y" + long[:60]), (3, long[700_000:700_100])]
    got = result(spark, rows)
    assert [(g[2], g[3]) for g in got] == [(0, 0), (2_499_000 + 60, 2), (100, 1)]


def test_hot_anchors(spark, monkeypatch):
    """Everything that ten documents share counts as hot."""
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    monkeypatch.setattr(S, "CHUNK", 2000)
    monkeypatch.setattr(S, "OFTEN", 3)
    rng = random.Random(9)
    tail = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))
    line = "this line stands in every document of the table, and in some of them twice over"
    rows = [(i, tail() + line + tail() + (line if i % 5 == 0 else "")) for i in range(120)] + [(500 + i, t) for i, t in corpus(6, "abc", 40)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "_id long, _text string").withColumn("_digest", F.lit(0))
    assert len(S.hot_anchors(df)) > 3
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "y" * 50), (5, "y" * 50), (6, ("long text %d, " % 7) * 20000), (7, ("long text %d, " % 7) * 20000 + "end")]
    got = result(spark, rows)
    assert [g[1:4] for g in got[:5]] == [(0, 0, 0), (0, 0, 0), (49, 0, 0), (50, 0, 0), (50, 50, 1)]
    assert got[6][2] == 13 * 20000 and got[6][3] == 1
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeats(df).count() == 0
    same = "a passage of more than fifty bytes that stands in several documents of this table"
    null = spark.createDataFrame([(None, same), (None, same), (3, same), (3, same)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.repeats(null).collect()) == [(0, len(same)), (0, len(same)), (3, 0), (3, 0)]


def test_one_id_with_two_texts(spark):
    a, b = "first text of the id, long enough to hold fifty bytes and some more", "second text of the id, again long enough to hold fifty bytes and more"
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.repeats(rows).collect()) == sorted([(1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (3, len(b), len(b))])


def test_cleaned(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "x" + shared, 41, "s"), (2, shared + "end", 43, "s"), (3, None, None, None)], "doc_id long, text string, n_chars long, _id string")
    got = S.cleaned(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "x" + shared and rows[2].text == "end" and rows[2].n_chars == 3 and rows[3].text == "" and rows[2]["_id"] == "s"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=120), max_size=6))
def test_refinement_equals_comparison(texts):
    data = [t.encode() for t in texts]
    size = np.array([len(b) for b in data], np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    number = S.refine(np.frombuffer(b"".join(data), np.uint8), left)
    seen = {}
    at = 0
    for b in data:
        for s in range(len(b)):
            w = b[s : s + L]
            assert (number[at + s] >= 0) == (len(w) == L)
            if len(w) == L:
                assert seen.setdefault(w, number[at + s]) == number[at + s]
        at += len(b)
    assert len(set(seen.values())) == len(seen)


def twins():
    """Two texts of one CRC-32, the first of them of many runs, the other of one."""
    a, rng = "a longer text, of several runs of windows, so that a run's number is beyond those of a short one: " * 3, random.Random(1)
    want = {zlib.crc32(x.encode()): x for x in (a + "".join(rng.choices("abcdefghijk mnop", k=9)) for _ in range(100_000))}
    while True:
        short = "short " + "".join(rng.choices("abcdefghijk mnop", k=9))
        if (got := want.get(zlib.crc32(short.encode()))) is not None:
            return got, short


def test_null_ids_of_equal_checksums(spark):
    long, short = twins()
    rows = [(1, long + "x"), (None, long), (None, short), (None, long)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long)
    assert got == sorted([(1, n + 1, 0), (0, n, n), (0, n, n), (0, len(short), 0)])


def test_other_names_and_keys(spark):
    df = spark.createDataFrame([(1, "t" * 60, "x"), (2, "t" * 60, "y")], "doc_id long, text string, `meta.lang` string")
    got = S.cleaned(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "t" * 60, "x"), (2, "", "y")]
    with pytest.raises(ValueError, match="integer"):
        S.repeats(df.withColumn("doc_id", F.lit("a")))


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "t", 2, 3)], "doc_id long, text string, part int, blob int").withColumn("spans", F.lit(1))
    assert S.repeats(df).first().n_removed == 0
