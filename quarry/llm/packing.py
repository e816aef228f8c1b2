"""Best-fit packing of documents into sequences of at most CAPACITY tokens, by linear grouping.

A document is its ids and a closing id. Only a document longer than a sequence is cut, into full pieces behind a first one
that may be shorter; full pieces are sequences of their own. Of the others:

1. Large pieces (above CAPACITY / LARGE_PARTS) are ranked by length, the longest first, and dealt into GROUPS groups of equal
   cardinality, whose lengths are rounded up to the group's largest. That leaves at most GROUPS sizes.
2. How often which configuration of sizes fills a sequence is a linear programme, solved by column generation (a knapsack
   over the dual prices finds the next configuration); what its fractions leave is packed best-fit, largest first.
3. The documents are substituted: the r-th of a size takes the r-th of its slots, which arithmetic finds from the
   configurations' running counts. No document is compared with another. Substitutes are shorter than their rounded sizes,
   so the last slot of a configuration is open to others: the documents planned for these slots are placed with step 4.
   Each still fits where it was planned, and best-fit never leaves fewer such places than documents.
4. These and the small pieces go best-fit, largest first, into what the others leave free, and then into new sequences.

The driver sees a histogram of lengths (at most CAPACITY rows) and a plan of at most 2 * GROUPS configurations, whatever the
corpus; so the table of slots that is broadcast has at most 2 * GROUPS * LARGE_PARTS rows. Ranks come from counts by
part and length, where a part is what one task wrote, and from numbers that the task gave; no window holds a length's pieces.
Sequences, with the documents planned to close them, and small pieces are dealt at random into shards of about SHARD rows for
step 4, so a task holds only its own; what a shard loses to the whole is about one sequence that isn't full.

The ids are those of the vocabulary's library of record (`tokenizers`), taken by a library that reads the same vocabulary as ranks
and is several times faster; tests hold them equal. Special tokens in a text count as in the former's default.

Defined results: a null text is empty; an empty text is the closing id alone; repeated rows and null keys are pieces of
their own; equal lengths are ordered by part, so the packing depends on how the table is split, and its number of sequences
hardly; an empty table gives no rows; texts are encoded whole, however long. Only key and text are read: extra columns may
have any name.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, materialise, prepare_python, sized, slices, table

CAPACITY = 2048
CLOSING_ID = 0
GROUPS = 128
LARGE_PARTS = 4
SHARD = 50_000
#: The programme is solved when no configuration saves more than this share of a sequence.
TOLERANCE = 0.0005
#: The pattern that cuts a text before byte pairs are merged, and the vocabulary's special token: fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict = {}


def encoder(data: bytes):
    """The encoding of a file of ranks, built once in a worker."""
    import tiktoken

    key = zlib.crc32(data)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[key]


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece of every row and, if asked for, its ids; part and place (a piece's
    number among those of its length in the part) name it. Written, since parts are those of one run."""
    import pyarrow as pa

    prepare_python(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, under 1 MB
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part long, place long" + (", ids array<int>" if ids else "")

    def run(batches):
        from pyspark import TaskContext

        e, part, seen = encoder(data.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for s in slices(b, 500):
                rows, whose = [], []
                for k, x in enumerate(s.column(1).to_pylist()):
                    got = np.append(e.encode_to_numpy(x or "", allowed_special="all"), np.uint32(closing_id)).astype("<u4")
                    at = [*cuts(len(got), capacity), len(got)]
                    for i in range(len(at) - 1):
                        one = got[at[i] : at[i + 1]]
                        seen[len(one)] += 1
                        whose.append(k)
                        rows.append((i, at[i], len(one), zlib.crc32(one.tobytes()), part, seen[len(one)] - 1, one if ids else None))
                columns = list(zip(*rows)) if rows else [[]] * 7
                types = [pa.int32(), *[pa.int64()] * 5]
                out = [s.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(columns[6], pa.list_(pa.int32()))] * ids, names=[key, "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * ids)
        give_back()

    return materialise(docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, schema), "pack-pieces")


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The best value of at most `most` items, any size as often as wanted, and how often each is taken. Items come in any
    order, so what is left after each is one of few rooms at first; the last item is read off a running maximum."""
    upto = np.concatenate([[0.0], np.maximum.accumulate(prices[::-1])])  # the best price of the k smallest sizes
    rising = sizes[::-1]
    took = []

    def best(rooms: np.ndarray, k: int) -> np.ndarray:
        """The best value for each of these rooms with at most k items."""
        if k == 1:
            return upto[np.searchsorted(rising, rooms, side="right")]
        inner = np.unique((rooms[:, None] - sizes[None, :]).ravel())
        inner = inner[inner >= 0]
        value = np.concatenate([best(inner, k - 1), [-np.inf]])
        at = np.searchsorted(inner, rooms[:, None] - sizes[None, :])
        at = np.where(rooms[:, None] >= sizes[None, :], at, len(inner))
        total = np.where(at < len(inner), prices[None, :] + value[at], 0.0)
        took.append((k, rooms, total.argmax(axis=1), total.max(axis=1)))
        return total.max(axis=1)

    value = float(best(np.array([capacity]), most)[0])
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for k, rooms, item, total in reversed(took):
        i = int(np.searchsorted(rooms, room))
        if total[i] > 0 and sizes[item[i]] <= room:
            pattern[item[i]] += 1
            room -= int(sizes[item[i]])
    fits = np.flatnonzero(sizes <= room)
    if len(fits) and prices[fits].max() > 0:
        pattern[fits[prices[fits].argmax()]] += 1
    return value, pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, int]]:
    """Configurations (how often each size stands in a sequence) and how many sequences have them; together they hold the
    demand exactly. sizes are distinct and fall."""
    m = len(sizes)
    left, out = demand.astype(np.int64).copy(), []
    if m and demand.max() > 1:
        # The basis starts as a diagonal and changes by a column at a time, so its inverse is kept by elementwise steps; what
        # rounding does to it costs sequences at most, as demand is met in integers below.
        basis = np.diag(capacity // sizes)
        inverse = np.diag(1 / np.diag(basis))
        for _ in range(50 * m):
            value, pattern = knapsack(sizes, np.maximum(inverse.sum(axis=0), 0), capacity, int(capacity // sizes[-1]))
            if value <= 1 + tolerance:
                break
            x, way = (inverse * demand).sum(axis=1), (inverse * pattern).sum(axis=1)
            ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
            k = int(ratio.argmin())
            basis[:, k] = pattern
            inverse[k] /= way[k]
            inverse -= np.where(np.arange(m) == k, 0, way)[:, None] * inverse[k][None, :]
        x = (inverse * demand).sum(axis=1)
        for j in np.argsort(-x):
            pattern = basis[:, j]
            times = min([int(max(x[j], 0) + 1e-6), *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
            if times > 0:
                out.append((pattern, times))
                left -= pattern * times
    rest: list = []  # best fit, largest first
    rooms: list[int] = []
    for j in range(m):
        for _ in range(int(left[j])):
            fit = min((r, k) for k, r in enumerate(rooms) if r >= sizes[j]) if any(r >= sizes[j] for r in rooms) else None
            if fit is None:
                rooms.append(capacity)
                rest.append(np.zeros(m, np.int64))
                fit = (capacity, len(rooms) - 1)
            rooms[fit[1]] -= int(sizes[j])
            rest[fit[1]][j] += 1
    return out + [(p, 1) for p in rest]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> dict:
    """From the number of pieces of each length: starts (rank of a length's first piece, longest first), full (pieces that
    fill a sequence), per_group, size_of_group (its number among the sizes), slots (size, lo, hi, base, each, first: the lo-th
    to hi-th piece of a size lie in sequences from base on, `each` to a sequence, from slot number first on), first_of_size
    (rank of a size's first piece, less the full ones) and sequences, those of full and large pieces."""
    lengths = sorted((n for n in histogram if n > capacity // LARGE_PARTS or n == capacity), reverse=True)
    starts, rank = {}, 0
    for n in lengths:
        starts[n] = rank
        rank += histogram[n]
    full = histogram.get(capacity, 0)
    large = rank - full
    per_group = max(1, -(-large // groups))
    ends = np.array([starts[n] + histogram[n] - full for n in lengths if n < capacity])
    short = np.array([n for n in lengths if n < capacity], np.int64)
    heads = np.arange(0, large, per_group)
    rounded = short[np.searchsorted(ends, heads, side="right")] if large else np.zeros(0, np.int64)
    sizes, size_of_group = np.unique(-rounded, return_inverse=True)
    sizes = -sizes
    count = np.bincount(size_of_group, np.minimum(per_group, large - heads), len(sizes)).astype(np.int64) if large else np.zeros(0, np.int64)
    slots, base, used = [], full, np.zeros(len(sizes), np.int64)
    for pattern, times in configurations(sizes, count, capacity):
        first = 0
        for j in np.flatnonzero(pattern):
            each = int(pattern[j])
            slots.append((int(j), int(used[j]), int(used[j]) + each * times, base, each, first, int(pattern.sum()) - 1))
            used[j] += each * times
            first += each
        base += times
    return {"starts": starts, "full": full, "per_group": per_group, "size_of_group": size_of_group.tolist(), "slots": slots, "first_of_size": (np.cumsum(count) - count).tolist(), "sequences": base}


def best_fit(lengths: list[int], gaps: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Places for pieces, which come largest first, in bins with these gaps or in new bins, numbered on: the tightest gap that
    fits. Returns each piece's bin and the gap that it finds there. A bit for each gap that some bin has finds the tightest."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for k, g in enumerate(gaps):
        at[g].append(k)
        bits |= 1 << g
    bins, before, n = [], [], len(gaps)
    for length in lengths:
        up = bits >> length
        if up:
            g = length + (up & -up).bit_length() - 1
            k = at[g].pop()
            if not at[g]:
                bits ^= 1 << g
        else:
            g, k, n = capacity, n, n + 1
        bins.append(k)
        before.append(g)
        at[g - length].append(k)
        bits |= 1 << (g - length)
    return bins, before


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """found, a table of pieces(), without ids and with sequence_id and offset: its place in the sequence."""
    import pyarrow as pa

    spark = found.sparkSession
    rows = found.drop("ids")
    columns = rows.columns
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    p = plan(histogram, capacity, groups)
    if not histogram:
        return rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    least = capacity // LARGE_PARTS
    large = rows.where((F.col("length") > least) | (F.col("length") == capacity))
    parts = large.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(spark.createDataFrame(list(p["starts"].items()) or [(0, 0)], "length long, start long"))  # a row a length
    parts = parts.join(starts, "length").select("length", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("start")).alias("before"))
    ranked = large.join(sized(materialise(parts, "pack-parts")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    full = ranked.where(F.col("length") == capacity).select(*columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    numbers = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs or [0]])
    rest = ranked.where(F.col("length") < capacity).withColumn("rank", F.col("rank") - p["full"])
    rest = rest.withColumn("size", F.element_at(numbers(p["size_of_group"]), F.floor(F.col("rank") / p["per_group"]).cast("int") + 1))
    rest = rest.withColumn("nth", F.col("rank") - F.element_at(numbers(p["first_of_size"]), F.col("size").cast("int") + 1))
    slots = F.broadcast(spark.createDataFrame(p["slots"] or [(-1, 0, 0, 0, 1, 0, 0)], "size long, lo long, hi long, base long, each long, first long, closing long"))
    placed = rest.join(slots, "size").where("nth >= lo AND nth < hi").withColumn("slot", F.expr("first + (nth - lo) % each"))
    placed = materialise(placed.select(*columns, F.expr("base + (nth - lo) div each").alias("sequence_id"), "slot", (F.col("slot") == F.col("closing")).alias("closes")), "pack-large")
    inside = Window.partitionBy("sequence_id")
    fixed = placed.where("NOT closes").withColumn("offset", F.coalesce(F.sum("length").over(inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fixed = materialise(fixed.withColumn("gap", capacity - F.sum("length").over(inside)).drop("closes"), "pack-fixed")
    small = (F.col("length") <= least) & (F.col("length") < capacity)
    n_small = sum(n for length, n in histogram.items() if length <= least and length < capacity)
    shards, base = max(1, -(-(2 * (p["sequences"] - p["full"]) + n_small) // shard)), p["sequences"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"

    def fill(t):
        """A shard's pieces in the gaps of its sequences, which are its rows with a gap, or in new sequences."""
        bin_ = t.column("gap").is_valid().to_numpy()
        bins, free = t.column("sequence_id").to_numpy()[bin_], t.column("gap").drop_null().to_numpy()
        mine = np.flatnonzero(~bin_)
        own = t.select(columns).take(mine)
        part, place, length = (own.column(c).to_numpy() for c in ("part", "place", "length"))
        order = np.lexsort((place, part, -length))
        at, before = best_fit(length[order].tolist(), free.tolist(), capacity)
        number = t.column("shard")[0].as_py()
        ids = np.array([bins[k] if k < len(bins) else base + (k - len(bins)) * shards + number for k in at], np.int64)
        return own.take(order).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(capacity - np.array(before, np.int64), pa.int64()))

    prepare_python(spark)
    of_sequence = F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).alias("shard")
    none = F.lit(None).cast("long")
    gaps = fixed.where("slot = 0 AND gap > 0").select(*[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes], "sequence_id", "gap", of_sequence)
    closing = placed.where("closes").select(*columns, "sequence_id", none.alias("gap"), of_sequence)
    loose = rows.where(small).select(*columns, none.alias("sequence_id"), none.alias("gap"), F.pmod(F.xxhash64("length", "part", "place"), F.lit(shards)).alias("shard"))
    filled = gaps.unionByName(closing).unionByName(loose).groupBy("shard").applyInArrow(fill, schema)
    return full.unionByName(fixed.select(*full.columns)).unionByName(filled)


def sequences(found: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the sequences themselves, of pieces() with ids and their pack()."""
    at = packed.select("part", "length", "place", "sequence_id", "offset").join(found.select("part", "length", "place", "ids"), ["part", "length", "place"])
    return at.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), default_ranks())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
