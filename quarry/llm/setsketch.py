"""MinHash near-dedup with SetSketch registers.

Sketch: register i of a document holds floor(1 - log_BASE(h)) of the least exponential variate h that hash i gives its
shingles, cut to 16 bits: exponentially spaced truncated minima, mergeable by maximum and locality-sensitive.

1. One pass over the texts gives, per document, the number of distinct shingles, a digest of the set and the registers.
   Documents with equal sets form a class, represented by its smallest id.
2. Every BAND_ROWS registers make a band; classes that agree in a band share a bucket. The smallest id of a bucket is its
   pivot (a map-side combined minimum), and each other member is paired with the pivot: as many pairs as members.
3. Pairs pass maybe(): the exact size bound, equal values in half of their registers (6.5 standard deviations below what
   the threshold gives), and a joint maximum-likelihood estimate of the similarity from both sketches, SLACK (five standard
   deviations) below the threshold. What passes is confirmed on the full shingle sets. Links are contracted to components.
4. Members of buckets that still hold several components are not compared with each other bucket by bucket: a template that
   many documents share below the threshold would cost the square of its documents. Their shingles are put in one order,
   those of a single component first, then by document frequency. Two linked sets then share a shingle among the first
   n - ceil(75 * (n + m) / 175) + 1 of each, n and m being their sizes, so only members that have an open shingle (one of
   several components) that early meet at all, by that shingle. Documents that share a template and differ in more than a
   seventh of their shingles have shingles of their own there, and meet nobody.
5. Those that meet pass maybe() on their registers alone; the groups that this connects, each document in one group, are
   compared exactly, in blocks of bounded bytes, and joined by a spanning set of links, never all pairs. The component that
   most of a group belongs to, which may be nearly all of it, is compared with the rest only. No bucket, shingle, partner or
   candidate is capped.

Components come from alternating large-star and small-star steps over written tables; nothing of a corpus's size comes to
the driver. Shingles are compared by 64-bit hashes of five word hashes.

Defined results: null, empty and blank texts have an empty set, link with nothing and stay; fewer than five words are one
shingle; repeated rows are one document; rows of one id with different texts share their links; a null id is never linked
beyond its own class; of equal sets, and of a component, the smallest id stays, so there are no ties; an empty table gives no
rows. Texts are read whole; long ones are hashed in pieces, so a text takes about five times its size at once. Only key and
text are read of docs (keep_one() returns all its columns): extra columns may have any name. Ids are integers, as the
smallest of a group stays; a table with other ids is refused.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_row, fields, integral, map_batches, materialise, mix_bits, powers_to, prepare_python, quoted, sized, table

SHINGLE = 5
PERCENT = 75
BANDS, BAND_ROWS = 32, 4
REGISTERS = BANDS * BAND_ROWS
#: So fine that unrelated sets agree in a register once in 4000: chance buckets would grow with the square of the corpus.
BASE = 1.001
#: Five standard deviations of an estimate from REGISTERS registers.
SLACK = 0.19
#: Members of a block of step 5, and bytes of their shingles, on average.
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
#: Bytes of a long text that are hashed at once.
PIECE = 1 << 20

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_STEP = np.uint64(0xD6E8FEB86659FD93)

_rng = np.random.Generator(np.random.PCG64(20240607))
_XOR = _rng.integers(0, 1 << 32, REGISTERS, np.uint32)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start = end - size
    up, down = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix_bits((sums[end] - sums[start]) * down[start] + size.astype(np.uint64))


def pieces(data: bytes):
    """A text in pieces of about PIECE bytes that end with a word."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > 2 * PIECE and (m := _BLANK.search(data, at + PIECE)):
            end = m.end()
        yield data[at:end]
        at = end


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, short, where = [], [], []
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if len(data) > PIECE:
            out.append(np.concatenate([word_hashes(w) for p in pieces(data) if (w := p.split())] or [np.zeros(0, np.uint64)]))
        else:
            where.append(len(out))
            short.append(data.split())
            out.append(None)
    flat = [w for words in short for w in words]
    words, at = word_hashes(flat) if flat else np.zeros(0, np.uint64), 0
    for k, x in zip(where, short):
        out[k] = words[at : at + len(x)]
        at += len(x)
    for k, w in enumerate(out):
        n = min(len(w), SHINGLE)
        if n:
            h = np.full(len(w) - n + 1, n, np.uint64)
            for j in range(n):
                h = h * _STEP + w[j : j + len(h)]
            out[k] = np.unique(mix_bits(h))
    return out


def registers(shingles: np.ndarray) -> bytes:
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 1024):
        v = (x[lo : lo + 1024, None] ^ _XOR) * _MUL
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= _MUL
        np.minimum(low, v.min(0), out=low)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype(np.uint16).tobytes()


def joint_estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of sizes na and nb, of whose registers more are larger in
    the first and less are larger in the second. The likelihood is concave: golden-section search."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (np.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(x) > value(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def maybe(na, nb, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Which pairs are within the size bound, agree in half their registers and are estimated not far below the threshold."""
    ok = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT
    ok[ok] = 2 * (ra[ok] == rb[ok]).sum(1) >= REGISTERS
    if ok.any():
        a, b = ra[ok], rb[ok]
        ok[ok] = joint_estimate(na[ok].astype(float), nb[ok].astype(float), (a > b).sum(1), (a < b).sum(1)) >= PERCENT / 100 - SLACK
    return ok


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    def make():
        def f(b):
            sets = shingle_sets(b[text])
            return {"id": b[key], "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "registers": [registers(s) if len(s) else None for s in sets]}

        return f

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), make, "id long, n_shingles long, digest binary, registers binary")


def with_sets(rows: DataFrame) -> DataFrame:
    """rows(id, text) to r (a key of the id and its set), id, n, registers, shingles (sorted 64-bit hashes)."""

    def make():
        def f(b):
            sets = shingle_sets(b["text"])
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8, key=str(i).encode()).digest(), "little", signed=True) for i, s in zip(b["id"], sets)]
            return {"r": keys, "id": b["id"], "n": [len(s) for s in sets], "registers": [registers(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return f

    return map_batches(rows, make, "r long, id long, n long, registers binary, shingles binary")


#: Ids of an aligned range of so many bits lie in one row of packed().
PACKED_BITS = 12


def packed(ids: DataFrame) -> DataFrame:
    """block, low: the distinct ids of ids(id), those of an aligned range in one row. With ids close together that is a tenth of a row
    an id, or less, so the few ids that a step needs of a corpus can be broadcast where they would else shuffle its texts."""
    by = ids.groupBy(F.shiftright("id", PACKED_BITS).alias("block"))
    return sized(materialise(by.agg(F.collect_set(F.col("id").bitwiseAND((1 << PACKED_BITS) - 1).cast("smallint")).alias("low")), "near-packed"))


def named(docs: DataFrame, key: str, ids: DataFrame, wanted: bool) -> DataFrame:
    """The rows of docs whose key is, or if not wanted is not, among packed ids. Null keys are among none."""
    block, low, of = "near_block", "near_low", F.col(quoted(key)).cast("long")
    ids = ids.select(F.col("block").alias(block), F.col("low").alias(low))
    is_ = F.coalesce(F.array_contains(low, of.bitwiseAND((1 << PACKED_BITS) - 1).cast("smallint")), F.lit(False))
    joined = docs.join(ids, F.shiftright(of, PACKED_BITS) == F.col(block), "inner" if wanted else "left")
    return joined.where(is_ if wanted else ~is_).drop(block, low)


def _registers(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def confirmed(pairs: DataFrame, sketched: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that are linked. sketched(id, n, registers) judges first; only what passes takes its sets along."""

    def estimate():
        def f(b):
            ok = maybe(np.array(b["na"], np.int64), np.array(b["nb"], np.int64), _registers(b["ra"]), _registers(b["rb"])).tolist()
            return {c: [x for x, k in zip(b[c], ok) if k] for c in "ab"}

        return f

    def compare():
        def f(b):
            ok = [linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(b["sa"], b["sb"])]
            return {c: [x for x, k in zip(b[c], ok) if k] for c in "ab"}

        return f

    side = lambda d, c: d.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    near = materialise(map_batches(pairs.join(side(sketched, "a"), "a").join(side(sketched, "b"), "b"), estimate, "a long, b long").distinct(), "near-pairs")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    return map_batches(sized(near).join(side("a"), "a").join(side("b"), "b"), compare, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """edges(a, b) with a > b to the same kind of edges, but all of a component to its smallest id."""
    edges = materialise(edges.where("a > b").distinct(), "link-edges")
    state = None
    while True:
        two_way = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(two_way.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "link-least")
        large = two_way.where("b > a").join(sized(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialise(large, "link-large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "link-least")
        small = large.join(sized(least), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = materialise(small, "link-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def needed(n: F.Column, m: F.Column) -> F.Column:
    """The least number of shingles that linked sets of sizes n and at least m share."""
    return F.greatest(F.ceil((n + m) * F.lit(PERCENT) / F.lit(100 + PERCENT)), F.ceil(n * F.lit(PERCENT) / F.lit(100)))


def tokens(sets: DataFrame) -> DataFrame:
    """r, component, n, token: each shingle of sets(r, component, n, shingles)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "r long, component long, n long, token long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                shingles = np.frombuffer(row[3], np.int64)
                for lo in range(0, len(shingles), 1 << 17):
                    part = shingles[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), x, np.int64)) for x in row[:3]), pa.array(part)], schema=schema)

    prepare_python(sets.sparkSession)
    return sets.select("r", "component", "n", "shingles").mapInArrow(run, ddl)


def meetings(sets: DataFrame) -> DataFrame:
    """bucket, r, component, n, at, main of sets(r, component, n, shingles): members of different components that are
    linked share a bucket, which is a shingle; at is the shingle's place in the member's order; main says that a member is
    of the component that most of the bucket are of."""
    several = F.min("component") < F.max("component")
    all_ = tokens(sets)
    open_ = all_.groupBy("token").agg(F.count("*").alias("df"), several.alias("open")).where("open").select("token", "df")
    open_ = materialise(open_, "near-open-shingles")
    # Shingles of one component come first in the order, so the place of an open one counts from the end.
    last = Window.partitionBy("r").orderBy(F.desc("df"), F.desc("token"))
    early = all_.join(sized(open_), "token").withColumn("at", F.col("n") - F.row_number().over(last))
    early = materialise(early.where(F.col("at") <= F.col("n") - needed(F.col("n"), F.lit(1))).select("token", "r", "component", "n", "at"), "near-early")
    least = early.groupBy("token").agg(F.min("n").alias("least"), several.alias("open")).where("open").select("token", "least")
    early = early.join(least, "token").where(F.col("at") <= F.col("n") - needed(F.col("n"), F.col("least"))).select(F.col("token").alias("bucket"), "r", "component", "n", "at")
    return materialise(with_main(early), "near-meetings")


def with_main(members: DataFrame) -> DataFrame:
    """members(bucket, component, ...) of buckets of several components, with main: the largest (then smallest) one."""
    by = members.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    most = by.groupBy("bucket").agg(F.count("*").alias("several"), F.max_by("component", F.struct("k", -F.col("component"))).alias("most")).where("several > 1")
    return members.join(most.select("bucket", "most"), "bucket").withColumn("main", F.col("component") == F.col("most")).drop("most")


def in_blocks(members: DataFrame, data: DataFrame, size: F.Column, work, schema: str) -> DataFrame:
    """work(blocks) over batches of (rows, others) of members(bucket, r, component, n, main, ...) joined with data(r, ...).
    Blocks hold BLOCK_ROWS members and BLOCK_BYTES of size on average, all main or none; a block that is not main is worked
    on alone (others is None), with each later block of its kind, and with each main block. Main blocks never meet each
    other. Rows are few bytes but much work, so they are dealt out to as many tasks as a shuffle has."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda main: F.ceil(F.greatest(F.sum(F.when(F.col("main") == main, size).otherwise(0)) / BLOCK_BYTES, F.count_if(F.col("main") == main) / BLOCK_ROWS)).cast("int")
    sizes = materialise(members.groupBy("bucket").agg(blocks(True).alias("n_main"), blocks(False).alias("n_rest")), "near-bucket-sizes")
    rows = members.join(sized(sizes), "bucket").withColumn("block", F.pmod(F.xxhash64("r"), F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    rows = rows.join(data, "r")
    fields = [c for c in rows.columns if c not in ("bucket", "n_main", "n_rest", "main", "block")]
    packed = materialise(rows.groupBy("bucket", "n_main", "n_rest", "main", "block").agg(F.collect_list(F.struct(*fields)).alias("rows")), "near-blocks")
    upto = lambda lo, hi, main: F.when(hi > lo, F.transform(F.sequence(lo, hi - 1), lambda j: F.struct(F.lit(main).alias("main"), j.alias("j")))).otherwise(F.array().cast("array<struct<main:boolean,j:int>>"))
    first = packed.where("NOT main").select("bucket", F.col("block").alias("i"), "rows", F.explode(F.concat(upto(F.lit(0), F.col("n_main"), True), upto(F.col("block"), F.col("n_rest"), False))).alias("with"))
    first = first.select("bucket", "i", "rows", "with.*")
    alone = first.where("NOT main AND i = j").select("bucket", "rows", F.lit(None).cast(packed.schema["rows"].dataType).alias("others"), "main", "i", "j")
    pair = first.where("main OR i < j").join(packed.select("bucket", "main", F.col("block").alias("j"), F.col("rows").alias("others")), ["bucket", "main", "j"]).select("bucket", "rows", "others", "main", "i", "j")
    dealt = alone.unionByName(pair).repartition(n, "bucket", "main", "i", "j").select("rows", "others")

    def batches():
        def f(b):
            out = list(work(list(zip(b["rows"], b["others"]))))
            return {c.split()[0]: [x[k] for x in out] for k, c in enumerate(schema.split(", "))}

        return f

    return map_batches(dealt, batches, schema, rows=64)


def early_enough(at, n, m) -> np.ndarray:
    """Whether the shingle in place `at` of a set of n may be the first that it shares with a linked set of m."""
    return at <= n - np.maximum(-(-(n + m) * PERCENT // (100 + PERCENT)), -(-np.maximum(n, m) * PERCENT // 100))


def candidates(blocks: list) -> list[tuple[list, list[tuple[int, int]]]]:
    """(rows, pairs of indices) of each block or two blocks: members of different components that pass maybe() and, where
    rows have `at`, may share nothing before their bucket's shingle. One call of maybe() serves all blocks."""
    out, found = [], []
    for own, others in blocks:
        rows = own + (others or [])
        component = np.array([r["component"] for r in rows])
        reg = _registers([r["registers"] for r in rows])
        n = np.array([r["n"] for r in rows])
        at = np.array([r["at"] for r in rows]) if "at" in rows[0] else None
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(rows) if others is None else len(own)):
            lo = i + 1 if others is None else len(own)
            far = lo + np.flatnonzero((component[lo:] != component[i]) & (np.minimum(n[lo:], n[i]) * 100 >= np.maximum(n[lo:], n[i]) * PERCENT))
            if at is not None and len(far):
                far = far[early_enough(at[far], n[far], n[i]) & early_enough(at[i], n[i], n[far])]
            if len(far):
                far = far[2 * (reg[far] == reg[i]).sum(1) >= REGISTERS]
                left.append(np.full(len(far), i))
                right.append(far)
        left, right = np.concatenate(left), np.concatenate(right)
        out.append([rows, left, right])
        found.append((n[left], n[right], reg[left], reg[right]))
    ok = maybe(*(np.concatenate(x) for x in zip(*found))) if found else np.zeros(0, bool)
    at = 0
    for x in out:
        keep = ok[at : at + len(x[1])]
        at += len(x[1])
        x[1:] = [list(zip(x[1][keep].tolist(), x[2][keep].tolist()))]
    return out


def forest(rows: list, pairs: list, name: str, test=None):
    """(larger, smaller) names that a pair joins, and passes the test if there is one; pairs that are joined already are
    passed over."""
    root = {r[name]: r[name] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, k in pairs:
        x, y = find(rows[i][name]), find(rows[k][name])
        if x != y and (test is None or test(rows[i], rows[k])):
            root[max(x, y)] = min(x, y)
            yield max(x, y), min(x, y)


def connect(blocks: list):
    for rows, pairs in candidates(blocks):
        yield from forest(rows, pairs, "r")


def link(blocks: list):
    for rows, pairs in candidates(blocks):
        yield from forest(rows, pairs, "component", lambda a, b: linked(np.frombuffer(a["shingles"], np.uint64), np.frombuffer(b["shingles"], np.uint64)))


def across(sets: DataFrame) -> DataFrame:
    """Links between different components of sets(r, component, n, registers, shingles): a spanning set of them."""
    edges = materialise(in_blocks(meetings(sets), sets.select("r", "registers"), F.lit(300), connect, "a long, b long"), "near-candidates")
    if edges.isEmpty():
        return edges
    groups = stars(edges)
    groups = materialise(groups.select(F.col("a").alias("r"), F.col("b").alias("bucket")).unionByName(groups.select(F.col("b").alias("r"), F.col("b").alias("bucket")).distinct()), "near-groups")
    members = materialise(with_main(groups.join(sets.select("r", "component", "n"), "r")), "near-group-members")
    return in_blocks(members, sets.select("r", "registers", "shingles"), F.col("n") * 8 + 300, link, "a long, b long")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component of every row of docs."""
    integral(docs, key)
    drawn = materialise(sketches(docs, key, text), "near-sketches")
    classes = materialise(drawn.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n")), "near-classes")
    classes = classes.where("class IS NOT NULL")
    sketched = classes.select(F.col("class").alias("id"), "n", "registers")
    band = [F.xxhash64(F.lit(i), F.substring("registers", 2 * i * BAND_ROWS + 1, 2 * BAND_ROWS)) for i in range(BANDS)]
    bands = classes.select(F.col("class").alias("id"), F.explode(F.array(*band)).alias("bucket"))
    pivots = materialise(bands.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("last > pivot").select("bucket", "pivot"), "near-pivots")
    shared = materialise(bands.join(sized(pivots), "bucket"), "near-members")
    ids = shared.select("id").distinct()
    sets = named(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", packed(ids), True)
    sets = materialise(with_sets(sets).where("n > 0"), "near-sets")
    if not sets.groupBy("r").count().where("count > 1").isEmpty():  # repeated rows
        sets = materialise(sets.dropDuplicates(["r"]), "near-sets")
    edges = confirmed(shared.where("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), sketched, sets)
    links = stars(edges)
    # What the pivots did not settle: buckets of more than one component.
    by_link = sized(links).select(F.col("a").alias("id"), "b")
    placed = materialise(shared.select("bucket", "id").join(by_link, "id", "left").select("bucket", "id", F.coalesce("b", "id").alias("component")), "near-placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    open_ = materialise(placed.join(sized(materialise(open_, "near-open")), "bucket").select("id", "component").distinct(), "near-open-ids")
    more = materialise(across(materialise(sets.join(sized(open_), "id"), "near-open-sets")), "near-across")
    if not more.isEmpty():
        links = stars(links.unionByName(more))
    top = classes.select("digest", "class").join(sized(links).select(F.col("a").alias("class"), F.col("b")), "class", "left").select("digest", F.coalesce("b", "class").alias("component"))
    top = materialise(top, "near-components")
    return drawn.select("id", "n_shingles", "digest").join(sized(top), "digest", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of every row of docs."""
    return components(docs, key, text).select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates() drops, and with one of each repeated row (same id and text): the
    first by its other columns, as JSON. Rows with a null id can't be told apart by key and stay. Only the dropped ids meet
    docs, broadcast if they are few."""
    judged = materialise(near_duplicates(docs, key, text), "near-judged")
    gone = judged.where(f"NOT kept AND {quoted(key)} IS NOT NULL").select(key).distinct()
    out = named(as_row(docs, "row", F.col(quoted(key)).alias(key)), key, packed(gone.select(F.col(quoted(key)).cast("long").alias("id"))), False)
    twice = materialise(judged.where("kept").groupBy(key).count().where("count > 1").select(key), "near-repeated")
    if twice.isEmpty():
        return out.select(*fields("row", docs.columns))
    of_row = F.col("row").getField
    first = out.join(twice, key, "left_semi").groupBy(key, of_row(text).alias("t")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.join(twice, key, "left_anti").select("row").unionByName(first.select("row")).select(*fields("row", docs.columns))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
