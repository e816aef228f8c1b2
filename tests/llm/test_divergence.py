import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=10, top=10):
    """The audit by its definition, in Python's integers."""
    n, d, words = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        n[lang or "", source or ""].update(terms)
        d[lang or ""].update(set(terms))
    out = []
    for lang in d:
        kept = [t for t, k in d[lang].items() if k >= least]
        groups = {s: c for (g, s), c in n.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, got in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(got)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(seed, n, sources, words):
    r = random.Random(seed)
    vocabulary = [r.choice(["", "É", "ß", "日", "\x85", "\U0001f600"]) + "".join(r.choices("abcDEF", k=3)) for _ in range(words)]
    out = []
    for i in range(n):
        s = 0 if r.random() < 0.4 else r.randrange(sources)
        text = r.choice([" ", "1", "_", "\n"]).join(r.choices(vocabulary[s % 7 :], k=r.randrange(60)))
        out.append((i, r.choice([text, text, text, "", None]), r.choice(["en", "de", None]), r.choice([f"s{s}", f"s{s}", None, ""]) if s == 3 else f"s{s}"))
    return out


@pytest.mark.parametrize("seed,block,slab,chunk", [(1, 32, 16, 4096), (2, 2, 1, 7), (3, 3, 2, 16)])
def test_matches_plain_integers(spark, seed, block, slab, chunk):
    rows = corpus(seed, 400, 11, 80)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n.x", F.lit(1))
    assert rows_of(D.audit(df, block=block, slab=slab, chunk=chunk)) == plain(rows)


def test_no_kept_terms_one_source_and_empty(spark):
    rows = [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (None, None, "en", "y"), (2, "", "fr", "z")] + [(k, "c " * 9, None, None) for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(D.audit(df)) == plain(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert D.audit(df.where("false")).count() == 0


def test_counts_above_what_a_product_of_longs_holds(spark):
    n, total = 4 * 10**15, 9 * 10**15
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t")).select(D.share("n", "t")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // total


def test_a_long_text_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    rows = [(k, " ".join(f"w{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}" for j in range(k * 40)), "en", f"s{k % 3}") for k in range(40)] + [(99, "lang " * 200_000, "en", "s0")]
    assert rows_of(D.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
