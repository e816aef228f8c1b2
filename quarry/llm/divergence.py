"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Terms are runs of ASCII letters (A-Z lower-cased) and of all code points above 127. A language keeps the terms in at least
MIN_DOCS of its documents. A group is a source of a language; with n a kept term's count in it, N the sum of these and V the
number of kept terms, the term's share is p = 1 + floor(SCALE * (n + 2) / (N + 2 * V)), an integer. Two shares differ by
floor((p - q)^2 / (p + q)). All arithmetic is exact: products pass 64 bits in decimals, sums of differences stay below 2^63.

Pairs of groups are computed by two-dimensional tiling. Kept terms are dealt into chunks of about CHUNK by a hash and
numbered within; a group's part in a chunk is packed into one row (numbers, shares, and one share for all terms it lacks).
Groups of a language fall into blocks of BLOCK, and a packed row is replicated to the tasks of its block with each block. A
task holds two blocks of one chunk at a time, as dense matrices, adds the chunk to its pairs' submatrix and goes on to the
next chunk; SLAB chunks make a task, so a large vocabulary is many tasks, and partial submatrices are added up. Neither a
group's vector, however many rows its source has, nor a pair of groups meets in one place otherwise.

Counting reads a text once; each task adds up the terms of its documents before any shuffle. The top terms of a group come
from a window whose limit Spark applies before the shuffle.

Defined results: null text, lang and source count as ''; empty texts and texts without terms have none, but their group
occurs; a language without kept terms (V = 0) has pairs of value 0; a source alone in its language has no pairs; ties rank by
item in UTF-8 order; repeated rows are documents of their own; a text is read whole, however long; an empty table gives no
rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, materialise, prepare_python, sized, slices, table

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Terms of a chunk, about; groups of a block; chunks of a task.
CHUNK, BLOCK, SLAB = 4096, 32, 16
#: Counts that a task holds before it passes them on.
HELD = 300_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs: occurrences of a term in a group and documents with it. A row without term for each group.
    Bytes above 127 are parts of terms, so terms are found in UTF-8 without decoding it."""
    import pyarrow as pa

    prepare_python(docs.sparkSession)
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        n: dict = defaultdict(Counter)
        d: dict = defaultdict(Counter)

        def rows():
            for (g, s), c in n.items():
                at = d[g, s]
                terms = [None, *(t.decode() for t in c)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(terms), pa.string()), pa.array([s] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([0, *c.values()], pa.int64()), pa.array([0, *(at[t] for t in c)], pa.int64())], schema=out)
            n.clear()
            d.clear()

        for b in batches:
            for part in slices(b, 500):
                for g, s, x in zip(*(c.to_pylist() for c in part.columns)):
                    words = (x or b"").translate(_FOLD).split()
                    n[g, s].update(words)
                    d[g, s].update(set(words))
                if sum(map(len, n.values())) > HELD:
                    yield from rows()
        yield from rows()
        give_back()

    named = [F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))]
    found = docs.select(*named, F.col(text).cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> F.Column:
    """1 + floor(SCALE * (n + 2) / total); total is above 0 where a term is kept."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(19, 0)) * {SCALE}BD) div cast({total} as decimal(19, 0))")


class Audit:
    """The tables of an audit of docs: langs (lang, total, chunks, v), groups (lang, source, g, total: N + 2 V) and
    entries (lang, source, g, chunk, i, term, p, q) of the kept terms that occur in a group."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, chunk: int = CHUNK):
        self.spark = docs.sparkSession
        found = materialise(counts(docs), "div-counts")
        terms = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
        terms = materialise(terms, "div-terms")
        by_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("n"))
        groups = found.where("term IS NULL").select("lang", "source")
        langs = groups.select("lang").distinct().join(by_lang, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_total"), F.ceil(F.coalesce("v", F.lit(0)) / chunk).alias("chunks"))
        self.langs = materialise(langs, "div-langs")
        # A chunk's terms are numbered in a window of about CHUNK rows.
        dealt = terms.join(sized(self.langs.where("v > 0")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
        dealt = dealt.withColumn("i", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        dealt = materialise(dealt.select("lang", "chunk", "i", "term", share("lang_n", "lang_total").alias("q")), "div-chunks")
        self.chunks = materialise(dealt.groupBy("lang", "chunk").agg(F.count("*").alias("m")), "div-chunk-sizes")
        kept = materialise(found.where("term IS NOT NULL").join(dealt, ["lang", "term"]).select("lang", "source", "chunk", "i", "term", "n", "q"), "div-kept")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = groups.join(sums, ["lang", "source"], "left").join(self.langs.select("lang", "v"), "lang").select("lang", "source", number.alias("g"), "v", (F.coalesce("n", F.lit(0)) + 2 * F.col("v")).alias("total"))
        self.groups = materialise(groups, "div-groups")
        self.entries = kept.join(sized(self.groups.select("lang", "source", "g", "total")), ["lang", "source"]).select("lang", "source", "g", "chunk", "i", "term", share("n", "total").alias("p"), "q")

    def packed(self) -> DataFrame:
        """lang, chunk, m (its terms), g, rest (share of the terms that the group lacks), i and p of those it has, in a list:
        one row for each group and chunk of a language, also if the group has no term of it."""
        vectors = self.entries.groupBy("lang", "g", "chunk").agg(F.collect_list("i").alias("i"), F.collect_list("p").alias("p"))
        all_ = self.groups.where("v > 0").select("lang", "g", F.expr(f"1 + 2 * {SCALE}L div total").alias("rest")).join(self.chunks, "lang")
        return all_.join(vectors, ["lang", "g", "chunk"], "left").select("lang", "chunk", "m", "g", "rest", "i", "p")

    def pairs(self, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
        """lang, a, b, value of every two groups (numbers a < b) of a language with kept terms."""
        import pyarrow as pa

        blocks = self.groups.groupBy("lang").agg((F.floor(F.max("g") / block) + 1).alias("blocks"))
        rows = self.packed().join(sized(materialise(blocks, "div-blocks")), "lang").withColumn("mine", F.floor(F.col("g") / block))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("lang", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.floor(F.col("chunk") / slab).alias("slab"), "chunk", "m", "g", "rest", "i", "p")
        prepare_python(self.spark)
        out = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

        def run(batches):
            tile, chunk, held, sums = None, None, [], None

            def add():
                """The chunk that is held goes into the submatrix."""
                nonlocal sums
                sums = np.zeros((2 * block, 2 * block), np.int64) if sums is None else sums
                lo, hi = tile[1] * block, tile[2] * block
                at = np.array([g - lo if g < lo + block else g - hi + block for g, *_ in held])
                dense = np.empty((len(held), held[0][1]), np.int64)
                for row, (_, _, rest, i, p) in zip(dense, held):
                    row[:] = rest
                    if i is not None:
                        row[i] = p
                left, right = np.flatnonzero(at < block), np.flatnonzero(at >= block) if lo < hi else np.flatnonzero(at < block)
                for k in left:
                    to = right if lo < hi else right[at[right] > at[k]]
                    for part in np.array_split(to, -(-len(to) // 8)) if len(to) else ():
                        d, s = dense[part] - dense[k], dense[part] + dense[k]
                        sums[at[k], at[part]] += ((d * d) // s).sum(axis=1)

            def done():
                if tile is None:
                    return
                add()
                a, b = np.nonzero(sums)
                names = np.r_[tile[1] * block + np.arange(block), tile[2] * block + np.arange(block)]
                yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(a), pa.string()), pa.array(names[a]), pa.array(names[b]), pa.array(sums[a, b])], schema=out)

            for batch in batches:
                for part in slices(batch, 64):
                    c = {k: v.to_pylist() for k, v in zip(part.schema.names, part.columns) if k not in "ip"}
                    lists = [(i.values.to_numpy() if i.is_valid else None, p.values.to_numpy() if p.is_valid else None) for i, p in zip(part.column("i"), part.column("p"))]
                    for lang, x, y, z, ch, m, g, rest, (i, p) in zip(c["lang"], c["x"], c["y"], c["slab"], c["chunk"], c["m"], c["g"], c["rest"], lists):
                        if (lang, x, y, z) != tile:
                            yield from done()
                            tile, chunk, held, sums = (lang, x, y, z), ch, [], None
                        elif ch != chunk:
                            add()
                            chunk, held = ch, []
                        held.append((g, m, rest, i, p))
            yield from done()
            give_back()

        keys = ["lang", "x", "y", "slab"]
        tiles = rows.repartition(*keys).sortWithinPartitions(*keys, "chunk", "g").mapInArrow(run, "lang string, a long, b long, value long")
        return tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def pair_rows(self, **tiling) -> DataFrame:
        """lang, source, part, item, value: the other sources of each group's language."""
        pairs = materialise(self.pairs(**tiling), "div-pairs")
        both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        g = self.groups.select("lang", "source", "g")
        every = g.select("lang", "source", F.col("g").alias("a")).join(g.select("lang", F.col("source").alias("item"), F.col("g").alias("b")), "lang").where("a <> b")
        return every.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    def term_rows(self) -> DataFrame:
        """lang, source, part, item, value: kept terms that a group has a larger share of than its language."""
        return self.entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, chunk: int = CHUNK, **tiling) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources by divergence (pair) and its most marked
    terms (term)."""
    a = Audit(docs, min_docs, chunk)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return a.pair_rows(**tiling).withColumn("rank", rank).unionByName(a.term_rows().withColumn("rank", rank).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT d.lang, coalesce(v, 0) AS v, coalesce(n, 0) + 2 * coalesce(v, 0) AS total FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1) k ON d.lang = k.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w SEMI JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce(s.n, 0) + 2 * l.v AS total FROM (SELECT DISTINCT lang, source FROM d) d JOIN l ON l.lang = d.lang LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s ON s.lang = d.lang AND s.source = d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // g.total)::HUGEINT AS p, (1 + ({SCALE}::HUGEINT * (k.n + 2)) // l.total)::HUGEINT AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows_) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
