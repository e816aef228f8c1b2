import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing as P


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(rows, capacity):
    """Sequences hold their pieces gaplessly from 0, and no more than fits. Returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min(((r, k) for k, r in enumerate(rooms) if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[fit[1]] -= n
    return len(rooms)


TEXTS = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b", "It's  é\n\n日本 \x00\x85 12,5 ", "word " * 5000, "x" * 30_000, " \t" * 4000]


def test_pieces_equal_the_library(spark):
    t = reference()
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("ab c\n'sé1.<|>日", k=rng.randrange(200))) for _ in range(60)] + ["a " * n for n in (2046, 2047, 2048, 4095, 4096)]
    rows = [(None if k == 3 else k // 2, x) for k, x in enumerate(texts)]
    found = P.pieces(docs(spark, rows).withColumn("piece", F.lit("clash")).withColumn("a.b", F.lit(1)), P.default_ranks(), ids=True)
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found.collect())
    want = []
    for key, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(2048, len(ids))
        at = [0, *range(first, len(ids), 2048)]
        for i, lo in enumerate(at):
            one = ids[lo : (at + [len(ids)])[i + 1]]
            want.append((str(key), i, lo, len(one), zlib.crc32(np.array(one, "<u4").tobytes()), tuple(one)))
    assert got == sorted(want)
    packed = P.pack(found)
    n = check(packed.collect(), 2048)
    held = {r.sequence_id: r.ids for r in P.sequences(found, packed).collect()}
    assert len(held) == n
    for r in packed.join(found.select("part", "length", "place", "ids"), ["part", "length", "place"]).collect():
        assert held[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(513, 2048), 30, replace=False))[::-1]
    demand = rng.integers(0, [2, 40, 3000, 10**9][seed], 30)
    out = P.configurations(sizes, demand, 2048)
    assert sum(p * n for p, n in out).tolist() == demand.tolist()
    assert all((p * sizes).sum() <= 2048 and n > 0 for p, n in out) and len(out) <= 60
    for most in (1, 2, 3):
        prices = rng.random(30)
        value, pattern = P.knapsack(sizes, prices, 2048, most)
        assert pattern.sum() <= most and (pattern * sizes).sum() <= 2048 and abs((pattern * prices).sum() - value) < 1e-9
        brute = np.zeros(2049)
        for _ in range(most):
            brute = np.maximum(brute, np.array([max([0, *(prices[j] + brute[w - n] for j, n in enumerate(sizes) if n <= w)]) for w in range(2049)]))
        assert abs(value - brute[2048]) < 1e-9


@pytest.mark.parametrize("name", ["mixed", "large", "small", "equal", "full"])
def test_few_sequences(spark, name):
    """Near the plain best fit of all pieces, and never more than a shard's sequence and a percent beyond."""
    rng = random.Random(name)
    lengths = {"mixed": [rng.choice([rng.randrange(1, 100), rng.randrange(1, 2049)]) for _ in range(3000)], "large": [rng.randrange(600, 2048) for _ in range(3000)],
               "small": [rng.randrange(1, 400) for _ in range(3000)], "equal": [700] * 2000 + [649] * 1000, "full": [2048] * 50}[name]
    rows = [(k, 0, 0, n, 0, k % 7, None) for k, n in enumerate(lengths)]
    places, numbered = defaultdict(int), []
    for r in rows:
        numbered.append((*r[:6], places[r[5], r[3]]))
        places[r[5], r[3]] += 1
    found = spark.createDataFrame(numbered, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long")
    for shard in (50_000, 500):
        got = P.pack(found, shard=shard).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
        n = check(got, 2048)
        most = best_fit_decreasing(lengths, 2048)
        assert n <= most * 1.01 + 1 + 2 * (2 * most + len(lengths)) // shard, (n, most)


def test_best_fit_takes_the_tightest_gap():
    assert P.best_fit([5, 5, 3, 2, 1], [6, 5, 9], 10) == ([1, 0, 2, 2, 0], [5, 6, 9, 6, 1])
    assert P.best_fit([8, 7, 3], [], 10) == ([0, 1, 1], [10, 10, 3])


def test_empty_and_other_capacities(spark):
    assert P.pack(P.pieces(docs(spark, []), P.default_ranks())).count() == 0
    only = P.pack(P.pieces(docs(spark, [(None, None)] * 3), P.default_ranks())).collect()
    assert check(only, 3) == 1 and [r.length for r in only] == [1] * 3
    found = P.pieces(docs(spark, [(k, "a b " * (k % 40)) for k in range(300)]), P.default_ranks(), capacity=16, closing_id=7)
    got = P.pack(found, capacity=16, groups=5, shard=100).collect()
    assert check(got, 16) >= sum(r.length for r in got) / 16
    assert sum(r.length for r in got) == sum(2 * (k % 40) + 1 + (k % 40 > 0) for k in range(300))


def test_the_given_documents(spark, sf):
    t = reference()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.op11_packing(spark, sf).collect()
    lengths, want = [], set()
    for r in d.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = [*P.cuts(len(ids), 2048), len(ids)]
        for i, (a, b) in enumerate(zip(at, at[1:])):
            want.add((r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(lengths)
    assert check(got, 2048) <= best_fit_decreasing(lengths, 2048) + 1
