import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing as M

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], DOCS)


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by plain repetition of the rule: give by weight, cap, reshare."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (left - sum(capped.values())) / sum(w[s] for s in rest) if rest else 0
        new = [s for s in rest if w[s] * level > most * sizes[s]]
        if not new:
            return capped | {s: w[s] * level for s in rest}
        capped |= {s: most * sizes[s] for s in new}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 70, None: 5, "d": 333}, {"a": 7}, {"a": 0, "b": 10}, {"é": 50, "z": 50, "Z": 50, "zz": 1}, {str(i): 10 + i * i for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = filled(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_taken_is_near_the_target_and_repeatable(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), f"s{i % 4}" if i % 9 else None) for i in range(900)] + [(1000, "w " * 5000, "s1")]
    a = M.mix(docs(spark, rows)).collect()
    b = M.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    assert all(r.taken <= 2 * r.size for r in a)
    by = {}
    for r in a:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 1 for target, taken in by.values())


def test_edges(spark):
    assert M.mix(docs(spark, [])).count() == 0
    only_null = M.mix(docs(spark, [(1, None, None), (2, "", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in only_null] == [(0, 0, 0.0)] * 2
    twice = M.mix(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a b c", "s")])).collect()
    assert len(twice) == 3 and abs(sum(r.taken for r in twice) - 1.5 * 7) <= 0.5


def test_repeat_keeps_columns_and_texts(spark):
    rows = [(i, f"text {i} " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)]
    df = docs(spark, rows).withColumn("size", F.lit(7)).withColumn("u", F.lit("x"))
    got = M.repeat(df)
    assert got.columns == df.columns
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id] == r.text for r in got.collect())
    total = got.select(F.sum(M.word_count())).first()[0]
    assert abs(total - 1.5 * sum(len(t.split()) for t in texts.values())) < 12


def test_repeat_with_any_column_names(spark):
    df = docs(spark, [(1, "a b c", "s"), (2, "d", "t"), (None, "e", "t")]).withColumn("_key", F.lit(1)).withColumn("_TIMES", F.lit(2)).withColumn("_copy", F.lit("c")).withColumn("a.b", F.lit(0)).withColumn("u", F.lit(0))
    got = M.repeat(df)
    assert got.columns == df.columns and {r["_TIMES"] for r in got.collect()} == {2}


def test_words_are_split_at_six_characters(spark):
    df = spark.createDataFrame([("a\x1cb\xa0c d\te\x0bf",), (None,), (" \n ",)], "text string")
    assert [r[0] for r in df.select(M.word_count()).collect()] == [4, 0, 0]
