import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import setsketch as S

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(UP).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for k in range(n):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    # A chain: each link is near, its ends are not.
    chain = [word() for _ in range(100)]
    for k in range(6):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(list(chain))
    rng.shuffle(rows)
    return [(i, (" " if i % 2 else "\n").join(w.upper() if i % 3 == 0 else w for w in ws)) for i, ws in enumerate(rows)]


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_shingles int")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(df).collect()}


def test_against_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_small_blocks_and_few_pivot_links(spark, monkeypatch):
    """Steps 4 and 5 with blocks of two, over a family in which the smallest document is the odd one out."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 2)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(24):
        copy = list(base)
        for at in rng.sample(range(120), 3 if k else 7):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "word " * 60000), (3, "word " * 50)]
    assert result(spark, rows) == brute(rows)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "zz")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in S.near_duplicates(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = S.keep_one(twice.withColumn("kept", F.lit(0)))
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(0, 0), (1, 0)]


def test_estimates_and_merging():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.75, 0.95):
        pool = rng.integers(0, 1 << 63, 3000, np.uint64)
        both = int(round(share * 2 * 1000 / (1 + share)))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:both], pool[1000 : 2000 - both]]))
        ra, rb = (np.frombuffer(S.registers(x), np.uint16) for x in (a, b))
        got = S.joint_estimate(np.array([len(a)], float), np.array([len(b)], float), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got - true) < S.SLACK
        assert (np.maximum(ra, rb) == np.frombuffer(S.registers(np.union1d(a, b)), np.uint16)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (101, 99)], "a long, b long")
    got = {r.a: r.b for r in S.stars(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99, 101: 99}


def templates(n, own, seed=5):
    """n documents of one text of 100 words and `own` words of their own; each tenth comes a second time, slightly changed."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(100)]
    rows = []
    for k in range(n):
        mine = [f"u{rng.randrange(10**9)}" for _ in range(own)]
        rows.append((2 * k, " ".join(base + mine)))
        if k % 10 == 0:
            mine[rng.randrange(own)] = "changed"
            rows.append((2 * k + 1, " ".join(base + mine)))
    return rows


def compared(spark, rows):
    """Pairs of documents that share a bucket of meetings(), each document being a component of its own."""
    data = [(i, i, len(x), x.tobytes()) for (i, _), x in zip(rows, S.shingle_sets([t for _, t in rows]))]
    m = S.meetings(spark.createDataFrame(data, "r long, component long, n long, shingles binary"))
    return m.groupBy("bucket").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]


def test_work_on_a_template_grows_with_its_documents(spark):
    """Similarity 1/2 by a shared template: of 12.5 million pairs only those of planted copies meet, by a few shingles each."""
    small, large = (compared(spark, templates(n, 50)) for n in (1250, 5000))
    assert 500 <= large <= 30 * 500 and large <= 5 * small
    assert compared(spark, templates(2000, 34)) <= 30 * 200  # similarity 0.57


def test_recall_below_a_template(spark):
    rows = templates(400, 50) + [(10_000 + i, t.replace("t5 ", f"d{i} ")) for i, t in templates(100, 30, 6)]
    assert result(spark, rows) == brute(rows)


def test_links_that_no_pivot_has(spark):
    """Windows over one long text: neighbours are linked, others not; and parts of a text with pieces left out, which have
    no shingle of their own."""
    rng = random.Random(8)
    text = [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(text[5 * k : 5 * k + 100])) for k in range(100)]
    rng.shuffle(rows)
    for k in range(60):
        cut = sorted(rng.sample(range(0, 140, 10), rng.choice([1, 2, 3])), reverse=True)
        left = [f"z{j}" for j in range(140)]
        for c in cut:
            del left[c : c + 10]
        rows.append((1000 + k, " ".join(left)))
    assert result(spark, rows) == brute(rows)


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "Cé", "long" * 9]) + rng.choice([" ", "\n", "  "]) for _ in range(5000))
    whole = S.shingle_sets([text])[0]
    monkeypatch.setattr(S, "PIECE", 1000)
    assert (S.shingle_sets([text, None, "a b"])[0] == whole).all()
    assert S.shingle_sets([" " * 5000, "x" * 5000])[1].size == 1


def test_the_given_documents(spark, sf):
    """All links of the given table, of any similarity above the threshold."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_ids_are_packed_by_range(spark):
    """4,000 ids next to each other are two rows, and rows are told apart by them as by a join: negative, far and null ids too."""
    from pyspark.sql import functions as F

    from quarry.llm import setsketch

    ids = spark.range(1000, 5000).unionByName(spark.createDataFrame([(-7,), (2**62,), (-7,)], "id long"))
    some = setsketch.packed(ids)
    assert some.count() == 4 and some.select(F.sum(F.size("low"))).first()[0] == 4002
    docs = spark.createDataFrame([(k, "x") for k in (None, -8, -7, 0, 999, 1000, 4999, 5000, 2**62, 2**62 + 1)], "id long, text string")
    assert {r.id for r in setsketch.named(docs, "id", some, True).collect()} == {-7, 1000, 4999, 2**62}
    assert {r.id for r in setsketch.named(docs, "id", some, False).collect()} == {None, -8, 0, 999, 5000, 2**62 + 1}
