import random

import pytest

from quarry.operators import index, search
from quarry.session import shared_folder

WORDS = ["the", "Idiot", "license", "a", "é", "of", "rare", "x9y"]


def corpus(seed, n, at=0):
    r = random.Random(seed)
    return [(at + i * 7, " ".join(r.choices(WORDS, weights=[30, 2, 3, 20, 1, 9, 1, 1], k=r.randrange(80)))) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus(1, 3000) + [(None, "the"), (-5, None), (-6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, index.Index(spark, shared_folder(spark, "ix"), buckets=4).add(df)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("terms", [["the", "idiot", "license"], ["rare"], ["IDIOT", "é"], ["nothing"], ["the", "nothing"], []])
def test_top_k_equals_search(built, terms):
    df, ix = built
    for k in (1, 20):
        assert rows(ix.top_k(terms, k)) == rows(search.search(df, terms, k))


def test_blocks_are_skipped_and_only_the_terms_are_read(built, spark):
    _, ix = built
    every, mine = ix._read("blocks"), ix.blocks(["the", "idiot"])
    assert 0 < ix.surviving(["the", "idiot"], 1).count() < mine.count() < every.count()
    assert mine.where("n > 4096").count() == 0 and mine.where("term = 'the'").count() > 8
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [idiot,the])" in plan
    files = lambda d: {r[0] for r in d.select("_metadata.file_path").distinct().collect()}
    assert files(ix.blocks(["rare"])) < files(every)


def plain_phrase(texts, phrase):
    import re

    want, words = set(), phrase.lower().split()
    for i, t in texts:
        if i is not None:
            ts = re.findall(r"[^\W\d_]+", (t or "").lower())
            want |= {(i, k) for k in range(len(ts)) if ts[k : k + len(words)] == words}
    return want


def test_phrases_and_windows(built):
    import re

    df, ix = built
    texts = [(r.doc_id, r.text) for r in df.collect()]
    for p in ("the idiot", "a the a", "the the the", "license of the", "x y"):
        assert set(rows(ix.phrase(p))) == plain_phrase(texts, p), p
    want = set()
    for i, t in texts:
        ts = re.findall(r"[^\W\d_]+", (t or "").lower())
        at = [(k, w) for k, w in enumerate(ts) if w in ("idiot", "rare", "of")]
        spans = [(b - a + 1, a, b + 1) for a, x in at for b, y in at if a <= b and {w for k, w in at if a <= k <= b} == {"idiot", "rare", "of"}]
        if i is not None and spans:
            want.add((i, *min(spans)[1:]))
    assert want and set(rows(ix.windows(["idiot", "rare", "Of"]))) == want


def test_generations(spark):
    base, later = corpus(2, 600), corpus(3, 80, at=350) + [(10**6, "the idiot of the license")]
    schema = "doc_id long, text string"
    gone = [(base[k][0],) for k in range(0, 600, 50)]
    ix = index.Index(spark, shared_folder(spark, "ix")).add(spark.createDataFrame(base, schema)).add(spark.createDataFrame(later, schema), spark.createDataFrame(gone, "doc_id long"))
    ix.add(spark.createDataFrame([], schema), spark.createDataFrame([(base[1][0],)], "doc_id long"))
    new = {k for k, _ in later}
    left = [r for r in base if r[0] not in new and (r[0],) not in gone] + later
    df = spark.createDataFrame([r for r in left if r[0] != base[1][0]], schema)
    want = rows(search.search(df, ["the", "idiot", "rare"], 15))
    assert rows(ix.top_k(["the", "idiot", "rare"], 15)) == want
    one = ix.merged(shared_folder(spark, "ix"))
    assert index.generations(spark, one.root) == [0] and rows(one.top_k(["the", "idiot", "rare"], 15)) == want
    assert set(rows(one.phrase("the idiot"))) == set(rows(ix.phrase("the idiot"))) == plain_phrase([tuple(r) for r in df.collect()], "the idiot")


def test_empty(spark):
    ix = index.Index(spark, shared_folder(spark, "ix")).add(spark.createDataFrame([], "doc_id long, text string"))
    assert ix.top_k(["a"]).count() == 0 and ix.phrase("a b").count() == 0 and ix.windows(["a"]).count() == 0


def test_texts_and_postings_are_shuffled_once_and_packed(spark, tmp_path, monkeypatch):
    """Not a row for each occurrence or posting: what a build shuffles is less than twice the text."""
    shuffled = lambda: sum(x.shuffleWriteBytes() for x in spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator().__class__ and [])


def test_rows_of_a_build_are_packed(spark, monkeypatch):
    """What a build shuffles and writes before its blocks is a row for each term and range of ids, not for each posting, also
    where a term has many pieces, ids are far apart or negative, and frequent terms are dealt by piece."""
    monkeypatch.setattr(index, "PIECE_BYTES", 2000)
    rows_, kept = corpus(5, 2000, at=-3000) + [(2**40, "the rare idiot"), (-(2**41), "the idiot"), (-3000, "zz the")], []
    write = index.Index._write
    monkeypatch.setattr(index.Index, "_write", lambda self, gen, partials, *a: (kept.append(partials.select("n").toPandas()["n"]), write(self, gen, partials, *a)))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    near = df.where("abs(doc_id) < 100000")
    for d in (df, near):
        ix = index.Index(spark, shared_folder(spark, "ix"), buckets=2).add(d)
        assert rows(ix.top_k(["the", "rare", "idiot"], 30)) == rows(search.search(d.groupBy("doc_id").agg({"text": "max"}).toDF("doc_id", "text"), ["the", "rare", "idiot"], 30))
        ix.add(d.where("doc_id % 5 = 0"), d.where("doc_id % 3 = 0").select("doc_id"))
        left = d.where("doc_id % 5 = 0 OR doc_id % 3 <> 0").groupBy("doc_id").agg({"text": "max"}).toDF("doc_id", "text")
        one = ix.merged(shared_folder(spark, "ix"))
        assert rows(one.top_k(["the", "rare"], 30)) == rows(ix.top_k(["the", "rare"], 30)) == rows(search.search(left, ["the", "rare"], 30))
        assert set(rows(one.phrase("the idiot"))) == plain_phrase([tuple(r) for r in left.collect()], "the idiot")
    assert all(len(n) < n.sum() / 2 for n in kept)
