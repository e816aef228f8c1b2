import math
import random

import numpy as np
import pytest

from quarry.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_agrees_with_labels_it_has_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.score(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == docs.count()
    held = labels.where("doc_id % 2 = 1").collect()
    assert sum(got[r.doc_id].kept == (r.quality == 1) for r in held) >= 0.97 * len(held)
    assert all(0 < r.score < 1 and 0 < r.path_posterior < 1 for r in got.values())


GOOD, BAD = "A quiet sentence about the sea and the boats in it. " * 8, "BUY!! NOW!! ### $$$ " * 30


def test_small_sites_stay_near_their_parent(spark):
    rows = [(i, GOOD if i % 10 else BAD, "big", "en") for i in range(400)] + [(1000 + i, BAD, "spam", "en") for i in range(300)] + [(5000, GOOD, "tiny", None), (5001, BAD, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[1] == GOOD), 0) for r in rows[:200] + rows[400:500]] + [(5000, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    by = {(r.host, r.path): r for r in Q.score(docs, labels).collect()}
    assert by["spam", "en"].host_posterior < 0.1 < 0.8 < by["big", "en"].host_posterior
    assert 0.2 < by["tiny", None].host_posterior < 1
    assert by["tiny", None].kept and not by[None, "x"].kept


def test_labels_of_a_site_outweigh_a_misled_classifier(spark):
    """Texts of one kind, good on one site and bad on the other: only the sites' labels tell them apart."""
    rows = [(i, GOOD, "honest" if i % 2 else "copied", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = Q.score(docs, labels).collect()
    assert all(r.kept == (r.host == "honest") for r in got)


def test_against_plain_sums(spark):
    """Every score again, from texts, sites and labels, with plain loops."""
    rng = random.Random(3)
    mixed = lambda: " ".join(rng.choice(["sea", "boat", "and", "the", "BUY!!", "###", "42", "end."]) for _ in range(rng.randrange(60)))
    rows = [(i, mixed(), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "de", None])) for i in range(300)] + [(7, "twice", "a", "en")]
    said = [(i, rng.randrange(2)) for i in rng.sample(range(320), 150)]
    said += [(said[0][0], 1 - said[0][1]), said[1], (said[2][0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got = [(*r[:3], *(round(x, 9) for x in r[3:7]), r.kept) for r in Q.score(docs, spark.createDataFrame(said, "doc_id long, quality int")).collect()]
    y = {}
    for i, v in said:
        if v is not None:
            y.setdefault(i, set()).add(v)
    y = {i: v.pop() for i, v in y.items() if len(v) == 1}
    known = [(Q.text_features(t), y[i], h, p) for i, t, h, p in rows if i in y]
    w, bias, share = Q.fit(np.array([k[0] for k in known]), np.array([k[1] for k in known], float))
    sums = {}
    for _, v, h, p in known:
        for g in ((), (h,), (h, p)):
            n, good = sums.get(g, (0, 0))
            sums[g] = (n + 1, good + v)
    mean = (sums[()][1] + 1) / (sums[()][0] + 2)

    def strength(groups):
        big = [(n, good, parent) for n, good, parent in groups if n > 1]
        return Q.strength_of(sum(n * (good / n - q) ** 2 for n, good, q in big), sum(q * (1 - q) for *_, q in big), sum(n for n, *_ in big), len(big))

    a = strength([(*s, mean) for g, s in sums.items() if len(g) == 1])
    up = lambda h, less=(0, 0): (a * mean + sums.get((h,), (0, 0))[1] - less[1]) / (a + sums.get((h,), (0, 0))[0] - less[0])
    b = strength([(*s, up(g[0])) for g, s in sums.items() if len(g) == 2])
    down = lambda h, p, less=(0, 0): (b * up(h, less) + sums.get((h, p), (0, 0))[1] - less[1]) / (b + sums.get((h, p), (0, 0))[0] - less[0])
    want = []
    for i, t, h, p in rows:
        doc = min(max(1 / (1 + math.exp(-(np.dot(Q.text_features(t), w) + bias))), Q.EDGE), 1 - Q.EDGE)
        prior = min(max(down(h, p, (int(i in y), y.get(i, 0))), Q.EDGE), 1 - Q.EDGE)
        odds = doc / (1 - doc) / (share / (1 - share)) * prior / (1 - prior)
        want.append((i, h, p, round(doc, 9), round(up(h), 9), round(down(h, p), 9), round(odds / (1 + odds), 9), odds / (1 + odds) >= Q.KEEP))
    key = lambda r: tuple(map(str, r))
    assert len(got) == len(want)
    for x, z in zip(sorted(got, key=key), sorted(want, key=key)):
        assert x[:3] == z[:3] and x[3:7] == pytest.approx(z[3:7], abs=1e-6) and x[7] == z[7]


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, host string, p_doc string"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.score(spark.createDataFrame([], schema), labels).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, "h", "p"), (1, None, None, None, "h", "p"), (2, "", "s", "en", "h", "p"), (3, "w " * 100000, "s", "en", "h", "p"), (None, "x", "s", "en", "h", "p")], schema)
    got = Q.score(docs, labels).collect()
    assert len(got) == 5 and len({round(r.p_doc, 9) for r in got}) == 1
    assert Q.score(docs, labels.where("false")).count() == 5


def test_fit_is_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, len(Q.FEATURES))), rng.integers(0, 2, 300).astype(float)
    w, b, _ = Q.fit(x, y)
    sd = x.std(0) + 1e-9
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(((x - x.mean(0)) / sd).T @ (y - p) - Q.PENALTY * len(y) * w * sd).max() < 1e-5
