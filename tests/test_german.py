from quarry.operators import german
from quarry.plans.queries import kept_table


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cuts(spark, counts):
    return {r.word: (r.first, r.rest) for r in german.splits(spark.createDataFrame(list(counts.items()), "term string, n long")).collect()}


def test_folding(spark):
    t = docs(spark, "Straße ÜBER ähnlich Öl", None, "")
    assert [r[0] for r in t.select(german.folded()).collect()] == ["strasse ueber aehnlich oel", "", ""]


def test_cuts(spark):
    counts = {"haus": 9, "tuer": 9, "haustuer": 5, "arbeit": 8, "zimmer": 4, "arbeitszimmer": 2, "haustuerarbeit": 1, "tuerhaus": 9, "tag": 99, "tagtag": 1, "selten": 1, "haussel": 1, "haustag": 1, "bund": 6, "bundeshaus": 2}
    assert cuts(spark, counts) == {"haustuer": ("haus", "tuer"), "arbeitszimmer": ("arbeit", "zimmer"), "haustuerarbeit": ("haustuer", "arbeit"), "bundeshaus": ("bund", "haus")}
    # tuerhaus is as frequent as its parts; tag is short; the larger mean wins, then the cut further left, then no link
    got = cuts(spark, {"aaaabbbb": 2, "cccc": 9, "aaaabbbbcccc": 1, "aaaa": 3, "bbbbcccc": 6})
    assert got == {"aaaabbbbcccc": ("aaaa", "bbbbcccc")}  # means of 18 and 18: the cut further left
    assert cuts(spark, {"tisch": 3, "tischs": 3, "lampe": 4, "tischslampe": 1})["tischslampe"] == ("tischs", "lampe")


def test_large_counts_are_exact(spark):
    n = 3_000_000_000_000_000_000
    assert cuts(spark, {"aaaa": n, "bbbb": n, "aaaabbbb": n}) == {}
    assert cuts(spark, {"aaaa": n, "bbbb": n, "aaaabbbb": n - 1}) == {"aaaabbbb": ("aaaa", "bbbb")}


def test_terms(spark):
    d = docs(spark, "Haus Tür Haustür", "Haus Haus Tür Arbeit", "Haustürarbeit Tür Arbeit Haustür Haus", None, "", "x" * 5000)
    got = {(r.doc_id, r.term): r.tf for r in german.terms(d, kept_table(spark, "german")).collect()}
    assert {t: n for (i, t), n in got.items() if i == 0} == {"haus": 2, "tuer": 2, "haustuer": 1}
    assert {t: n for (i, t), n in got.items() if i == 2} == {"haustuerarbeit": 1, "haus": 3, "tuer": 3, "arbeit": 2, "haustuer": 1}
    assert {i for i, _ in got} == {0, 1, 2, 5}
    assert german.terms(d.where("false"), kept_table(spark, "german")).count() == 0
