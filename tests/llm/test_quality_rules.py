import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, t in enumerate(triples) if triples.count(t) > 1 for k in (i, i + 1, i + 2)}
    seen, dups = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.append(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x1c\x85#é", max_size=80))
def test_counts(text):
    got = [c[0] for c in Q.judged([text])]
    assert tuple(got[:6]) == plain(text)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(1, 7, 5)
        scores, t = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
        got, at = Q.viterbi(scores, counts, t), 0
        for c in counts.tolist():
            value = lambda y: sum(scores[at + i] for i in range(c) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert value(got[at : at + c]) == max(map(value, itertools.product([0, 1], repeat=c)))
            at += c


CLEAN = """The river rose again in the night, and by morning the lower road was under water.
Nobody had slept much, but the boats were ready and the children had been carried up the hill.
Later the council wrote down which houses had lost their cellars, their hens or their winter wood.
An old engineer explained that a second sluice, once planned, had never been paid for.
His drawings still hung in the school, beside a map of every field between here and the coast.
When spring came, two of his pupils measured the banks with a rope and a borrowed level."""


def verdict(text):
    return Q.judged([text])[-1][0]


def test_verdicts():
    assert verdict(CLEAN)
    assert verdict(CLEAN + "\nLicensed under the Apache License, Version 2.0.")
    assert verdict(CLEAN.replace("\n", " "))
    assert not verdict(" ".join(f"{w}###" for w in CLEAN.split()))
    assert not verdict(" ".join(f"{w.upper()}!!" for w in CLEAN.split()))
    assert not verdict(" | ".join(CLEAN.split()))
    assert not verdict("short text")
    assert not verdict(None)
    assert not verdict("")


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    assert sum((r.quality == 1) == r.kept for r in got) >= 0.98 * len(got)
    assert all(r.kept for r in got if r.quality == 1)


def test_frames(spark):
    df = spark.createDataFrame([(1, CLEAN, "a"), (1, CLEAN, "a"), (2, None, None), (None, "x " * 100000, "b")], "doc_id long, text string, kept string")
    rows = Q.judge(df).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    kept = Q.keep(df)
    assert kept.columns == df.columns and [r.kept for r in kept.collect()] == ["a", "a"]
    assert Q.judge(df.where("false")).count() == 0


def plain_verdict(text):
    """kept by the rule itself: base rules, then the best of the labellings line by line, one document at a time."""
    w, t = Q.weights()
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:]))
    twice = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(twice) > 50 * len(words):
        return False
    seen, best, sizes = set(), None, []
    for line in text.split("\n"):
        n, r = Q.features(line, line in seen)
        if line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
        up = sum(w[i] for i in r) + w[-1]
        sizes.append(n)
        if best is None:
            best = [(0.0, [0]), (up, [1])]
        else:
            step = [max(((best[a][0] + t[a, b], -a) for a in (0, 1))) for b in (0, 1)]
            best = [(step[b][0] + up * b, best[-step[b][1]][1] + [b]) for b in (0, 1)]
    states = max(best, key=lambda x: x[0])[1]
    return sum(n for n, x in zip(sizes, states) if x) >= Q.MIN_CONTENT * sum(sizes)


def test_verdicts_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    want = {r.doc_id: plain_verdict(r.text) for r in docs.collect()}
    assert got == want and {True, False} == set(got.values())
