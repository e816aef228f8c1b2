"""German words for search (an extension): folded letters, and compounds split by the corpus itself.

Folding writes umlauts and the sharp s with two plain letters, also where the umlaut's dots are a combining mark. A compound is
split where both parts are words of the corpus, of at least MIN_PART letters and MIN_COUNT occurrences, and their counts'
geometric mean is above the word's own count; between the parts may stand a linking s or es, which goes. Of several cuts the
one with the largest mean wins, then the one further left, then the one without a link. Parts are split in turn. There is no
word list: counts are grouped, and candidates find their parts by joins. Runs of more than MAX_WORD letters are no compounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import TOKEN

MIN_PART, MAX_WORD, MIN_COUNT = 4, 80, 2
LINKS = ("", "s", "es")
#: The letters of the German alphabet beyond a to z, as plain ones.
FOLDS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
_COMBINED = (("a\u0308", "ae"), ("o\u0308", "oe"), ("u\u0308", "ue"))


def folded(text: str = "text") -> Column:
    """Lower-cased text with plain letters; null is ''."""
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    for old, new in (*FOLDS, *_COMBINED):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf of the folded words of each document with a key."""
    terms = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
    return docs.where(F.col(key).isNotNull()).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def splits(counts: DataFrame) -> DataFrame:
    """word, first, rest of counts(term, n): the best cut of each word that has one. Candidates without a known first part are
    gone before they are dealt again for the second. The parts' side has one row a word, so a first part that many words
    share is skewed on one side only, which adaptive execution splits."""
    n = F.length("term")
    cuts = counts.where(n.between(2 * MIN_PART, MAX_WORD)).select("term", "n", F.explode(F.sequence(F.lit(MIN_PART), n - MIN_PART)).alias("cut"))
    whole = F.substring(F.col("term"), F.lit(1), F.col("cut"))
    links = [F.when(F.endswith(whole, F.lit(x)) & (F.col("cut") - len(x) >= MIN_PART), F.struct(F.expr(f"substring(term, 1, cut - {len(x)})").alias("first"), F.lit(len(x)).alias("link"))) for x in LINKS]
    cand = cuts.select("term", "n", "cut", F.explode(F.array_compact(F.array(*links))).alias("l"), F.expr("substring(term, cut + 1)").alias("rest"))
    cand = cand.select("term", "n", "cut", "l.first", "l.link", "rest")
    part = counts.where((F.col("n") >= MIN_COUNT) & (n >= MIN_PART))
    known = cand.join(part.select(F.col("term").alias("first"), F.col("n").alias("nf")), "first")
    both = known.join(part.select(F.col("term").alias("rest"), F.col("n").alias("nr")), "rest")
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    better = both.withColumn("product", dec("nf") * dec("nr")).where(F.col("product") > dec("n") * dec("n"))
    best = better.groupBy("term").agg(F.max(F.struct("product", (-F.col("cut")).alias("c"), (-F.col("link")).alias("k"), "first", "rest")).alias("b"))
    return best.select(F.col("term").alias("word"), "b.first", "b.rest")


def parts(cut: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """word, part of splits(...): each compound's parts that are not split further, as often as they occur. A round splits
    all parts once more; parts are shorter than what they come from, so it ends. keep writes a table and reads it again, so
    that a round starts from the last and not from the corpus."""
    pair = cut.select("word", F.explode(F.array("first", "rest")).alias("part"))
    done = None
    inner = cut.select(F.col("word").alias("part"), F.array("first", "rest").alias("two"))
    while True:
        pair = keep(pair.join(inner, "part", "left").select("word", "part", "two"))
        whole = pair.where("two is null").select("word", "part")
        done = whole if done is None else done.unionAll(whole)
        pair = pair.where("two is not null").select("word", F.explode("two").alias("part"))
        if pair.isEmpty():
            return done


def terms(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf: each document's folded words, and in addition the parts of its compounds."""
    found = keep(words(docs, key, text))
    cut = keep(splits(found.groupBy("term").agg(F.sum("tf").alias("n"))))
    inner = found.join(parts(cut, keep).withColumnRenamed("word", "term"), "term").select(key, F.col("part").alias("term"), "tf")
    return found.select(key, "term", "tf").unionAll(inner).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
