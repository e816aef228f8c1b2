"""A written inverted index with positions: top-k, phrases and windows of terms without reading a text again.

Layout below a root: `blocks`, `terms`, `docs` and `dead`, in each a folder per generation (a batch of documents). A block
holds the postings of one term for ids of one aligned range of 2^level ids: ids as differences from the range's first,
frequencies, lengths and positions, and the largest weight of a posting at the generation's mean length. level follows from the term's document
frequency, so that a block holds about BLOCK postings and a term in every document is many blocks, in many tasks. Blocks are
written in order of term, in files of even size, with a bucket of the term's hash as folder: a query opens its terms' folders
and, by the files' statistics, their row groups only.

A later generation replaces and removes documents: `dead` lists the ids that it makes void in older ones. The last generation
with an id decides. merged() folds generations into one.

top_k() never opens a block whose documents can't reach the k best: each block's upper bound, its largest weight
times what the mean length has grown by since it was written, plus those of the other terms' blocks over the same ids (ranges of powers of two nest, so that is an equi-join),
must reach the k-th best score among the documents of the most promising blocks.

Rows without an id are not indexed; null and empty texts are documents without terms; of rows of one id in a batch, the one
with the greatest text counts; an empty batch is a generation without rows. Scores, tokens and ties are those of search().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.search import B, K1, tokens

BLOCK = 128
BUCKETS = 32
#: Blocks that are opened to learn what score the k best reach.
PROBES = 8
#: What rounding of scores may add to one.
SLACK = 1e-6


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, root: str) -> list[int]:
    """The complete generations: `dead` is written last."""
    at, fs = _fs(spark, f"{root}/dead")
    if not fs.exists(at):
        return []
    return sorted(int(x.getPath().getName()[4:]) for x in fs.listStatus(at) if fs.exists(_fs(spark, f"{x.getPath()}/_SUCCESS")[0]))


SCHEMAS = {
    "blocks": "term string, level int, range long, n int, best double, avg double, ids array<bigint>, tfs array<int>, lens array<int>, positions array<array<int>>, gen int, bucket int",
    "terms": "term string, df long, level int, gen int",
    "docs": "key long, len int, gen int",
    "dead": "key long, gen int",
}


def weight(tf, length, avg) -> F.Column:
    """A posting's share of its document's score, without the term's rarity. With a mean length r > 1 times as large it grows
    by less than r, with a smaller one it falls."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def levels_from(span: int) -> list[int]:
    """The least document frequencies of levels 0, 1, ... for ids in `span`: a term takes the first level whose one it reaches."""
    return [min(-(-BLOCK * span // 2**level), 2**63 - 1) for level in range(62)]


#: The postings of a term for ids of one range of 2^level ids: n of them, packed; level is one for all rows. A row without a term
#: lists ids, with a number each.
PARTIAL = "term string, piece long, n int, data binary, ids array<bigint>, lens array<int>"


def _tools():
    """lists(offsets, values, kind), pack and unpack. Functions of a function, so that they are sent to executors along with it."""
    import numpy as np
    import pyarrow as pa

    def lists(offsets, values, kind):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def places(start, n):
        """start[i], start[i] + 1, ... n[i] times."""
        return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)

    def gaps(values, first, base):
        out = np.diff(values, prepend=0)
        out[first] = values[first] - base
        return out

    def pack(n, base, ids, tfs, lens, positions):
        """A binary for each row of n[i] postings: ids from base[i] on, frequencies, lengths and positions, ids and positions as
        differences, in 7 bits a byte."""
        first = np.cumsum(n) - n
        words = np.add.reduceat(np.append(tfs, 0), first).astype(np.int64) if len(n) else n
        start = np.cumsum(3 * n + words) - 3 * n - words
        v = np.zeros(int((3 * n + words).sum()), np.int64)
        for k, x in enumerate((gaps(ids, first, base), tfs, lens)):
            v[places(start + k * n, n)] = x
        v[places(start + 3 * n, words)] = gaps(positions, np.cumsum(tfs) - tfs, 0)
        size = np.ones(len(v), np.int64)
        for k in range(1, 9):
            size += v >= 1 << 7 * k
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        which = np.arange(len(v))
        for k in range(9):
            which = which[size[which] > k]
            if not len(which):
                break
            out[at[which] + k] = v[which] >> 7 * k & 127 | (size[which] > k + 1) * 128
        offsets = np.append(at, len(out))[np.append(start, len(v))]
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])

    def unpack(n, base, data):
        """ids, tfs, lens, positions of all rows."""
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
        end = np.flatnonzero(raw < 128)
        at = np.append(0, end + 1)[:-1]
        size, v, which = end - at + 1, np.zeros(len(end), np.int64), np.arange(len(end))
        for k in range(9):
            which = which[size[which] > k]
            if not len(which):
                break
            v[which] |= (raw[at[which] + k] & 127).astype(np.int64) << 7 * k
        start = np.searchsorted(at, offsets[:-1] - offsets[0]) if len(data) else n
        ids, tfs, lens = (v[places(start + k * n, n)] for k in range(3))
        many = np.diff(np.append(start, len(v))) - 3 * n

        def summed(x, first, base):
            total = np.cumsum(x)
            return total - np.repeat((total - x)[first] - base, np.diff(np.append(first, len(x))))

        return summed(ids, np.cumsum(n) - n, base), tfs, lens, summed(v[places(start + 3 * n, many)], np.cumsum(tfs) - tfs, 0)

    return lists, pack, unpack


#: A generation's text in one range of ids whose postings lie together, about; and in one file of blocks.
PIECE_BYTES, FILE_BYTES = 24 << 20, 8 << 20
#: Tokens and documents that are sorted at once, and postings that are made blocks at once.
CHUNK = 1 << 22


def _inverted(level: int):
    """Batches of (key, tokens), in order of key, to PARTIAL rows: the postings of a term in ids of one range of 2^level, the
    positions of all its documents in one array. A row without a term lists the documents. Of equal keys the first counts."""
    import numpy as np
    import pyarrow as pa

    chunk, (lists, pack, _) = CHUNK, _tools()

    names = [c.split()[0] for c in PARTIAL.split(", ")]

    def invert(piece, keys, tokens):
        keys, size = np.concatenate(keys), np.concatenate([np.diff(t.offsets.to_numpy()) for t in tokens])
        code = pa.concat_arrays([t.flatten() for t in tokens]).dictionary_encode()
        words, code = code.dictionary, code.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # by term; documents and positions stay in order
        doc = np.repeat(np.arange(len(keys)), size)[order]
        pos = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size))[order]
        code = code[order]
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)])
        code, doc, upto = code[at], doc[at], np.append(at, len(order))
        first = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)]), len(at))
        n = np.diff(first)
        data = pack(n, np.full(len(n), piece << level), keys[doc], np.diff(upto), size[doc], pos)
        rows = pa.RecordBatch.from_arrays([words.take(pa.array(code[first[:-1]])), pa.array(np.full(len(n), piece)), pa.array(n, pa.int32()), data, pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int32()))], names=names)
        all_ = [0, len(keys)]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([piece], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([None], pa.binary()), lists(all_, keys, pa.int64()), lists(all_, size, pa.int32())], names=names)
        for lo in range(0, rows.num_rows, 10_000):
            yield rows.slice(lo, 10_000)

    def run(batches):
        keys, tokens, size, piece, last = [], [], 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            new = np.append(ids[0] != last, ids[1:] != ids[:-1])
            last, b = ids[-1], b.filter(pa.array(new))
            ids = ids[new]
            at = np.append(np.append(0, np.flatnonzero(ids[1:] >> level != ids[:-1] >> level) + 1), len(ids)) if len(ids) else [0]
            for lo, hi in zip(at[:-1], at[1:]):
                now = int(ids[lo] >> level)
                if keys and (now != piece or size >= chunk):
                    yield from invert(piece, keys, tokens)
                    keys, tokens, size = [], [], 0
                piece = now
                keys.append(ids[lo:hi])
                tokens.append(b.column(1).slice(lo, hi - lo))
                size += int(hi - lo) + len(tokens[-1].flatten())
        if keys:
            yield from invert(piece, keys, tokens)

    return run


def _blocked(least: list[int], avg: float, width: int):
    """PARTIAL rows with bucket and level, in order of term and piece, to blocks. A row with a level brings all that there is of
    its term and piece; one without comes with all others of its term, which give the level."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    chunk, (lists, _, unpack), k1, b_ = CHUNK, _tools(), K1, B
    rising = np.array(least[::-1], np.int64)

    def groups(t):
        code = t.column("term").combine_chunks().dictionary_encode()
        code = (code if isinstance(code, pa.DictionaryArray) else code.combine_chunks()).indices.to_numpy()
        level = t.column("level").fill_null(-1).to_numpy()
        piece = t.column("piece").to_numpy()
        return code, level, np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (level[1:] >= 0) & (piece[1:] != piece[:-1])))

    def blocks(t):
        (code, level, _), n = groups(t), t.column("n").to_numpy()
        df = np.zeros(code[-1] + 1, np.int64)
        np.add.at(df, code, n)
        level = np.where(level >= 0, level, len(rising) - np.searchsorted(rising, df[code], "right"))
        row = np.repeat(np.arange(len(n)), n)
        ids, tfs, lens, positions = unpack(n.astype(np.int64), t.column("piece").to_numpy() << width, t.column("data").combine_chunks())
        upto = np.append(0, np.cumsum(tfs, dtype=np.int64))
        positions = lists(upto, positions, pa.int32())
        if not ((code[row[1:]] != code[row[:-1]]) | (ids[1:] > ids[:-1])).all():  # several generations
            order = np.lexsort((ids, code[row]))
            ids, tfs, lens, row, positions = ids[order], tfs[order], lens[order], row[order], positions.take(pa.array(order))
        range_ = ids >> level[row]
        at = np.flatnonzero(np.append(True, (code[row[1:]] != code[row[:-1]]) | (range_[1:] != range_[:-1])))
        own, upto = row[at], np.append(at, len(row))
        best = np.maximum.reduceat(tfs * (k1 + 1) / (tfs + k1 * (1 - b_ + b_ * lens / avg)), at)
        out = pa.RecordBatch.from_arrays([
            t.column("term").combine_chunks().take(pa.array(own)), pa.array(level[own], pa.int32()), pa.array(range_[at], pa.int64()), pa.array(np.diff(upto), pa.int32()), pa.array(best), pa.array(np.full(len(at), avg)),
            lists(upto, ids - (range_ << level[row]), pa.int64()), lists(upto, tfs, pa.int32()), lists(upto, lens, pa.int32()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), positions), t.column("bucket").combine_chunks().take(pa.array(own))],
            names=["term", "level", "range", "n", "best", "avg", "ids", "tfs", "lens", "positions", "bucket"])
        for lo in range(0, out.num_rows, 10_000):
            yield out.slice(lo, 10_000)

    def run(batches):
        held, size, limit = [], 0, chunk
        for b in batches:
            held.append(b)
            size += int(pc.sum(b.column("n")).as_py() or 0)
            if size < limit:
                continue
            t = pa.Table.from_batches(held)
            last = int(groups(t)[2][-1])
            if last:
                yield from blocks(t.slice(0, last))
                held, limit = t.slice(last).to_batches(), chunk
                size = sum(pc.sum(x.column("n")).as_py() for x in held)
            limit = max(chunk, 2 * size)
        if any(b.num_rows for b in held):
            yield from blocks(pa.Table.from_batches(held))

    return run


def _pieces(level: int):
    """Blocks to PARTIAL rows with their generation, one for each range of 2^level ids."""
    import numpy as np
    import pyarrow as pa

    (_, pack, _), names = _tools(), [c.split()[0] for c in PARTIAL.split(", ")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = dict(zip(b.schema.names, b.columns))
            n = np.diff(c["ids"].offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            ids = c["ids"].flatten().to_numpy() + c["first"].to_numpy()[row]
            positions = c["positions"].flatten()
            piece, upto = ids >> level, positions.offsets.to_numpy() - positions.offsets[0].as_py()
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])))
            own, n = pa.array(row[at]), np.diff(np.append(at, len(row)))
            data = pack(n, piece[at] << level, ids, np.diff(upto), c["lens"].flatten().to_numpy(), positions.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([c["gen"].take(own), c["term"].take(own), pa.array(piece[at]), pa.array(n, pa.int32()), data, pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int32()))], names=["gen", *names])

    return run


def _alive(level: int):
    """PARTIAL rows with their generation, by piece, behind the piece's rows without a term, which list void ids and the generations
    from which on they are void: the postings that count."""
    import numpy as np
    import pyarrow as pa

    (_, pack, unpack), names = _tools(), [c.split()[0] for c in PARTIAL.split(", ")]

    def run(batches):
        at, void, by = None, np.zeros(0, np.int64), np.zeros(0, np.int32)
        for b in batches:
            piece = b.column("piece").to_numpy()
            cuts = np.append(np.append(0, np.flatnonzero(piece[1:] != piece[:-1]) + 1), len(piece)) if len(piece) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                if piece[lo] != at:
                    at, void, by = piece[lo], void[:0], by[:0]
                heads = part.filter(part.column("term").is_null())
                if heads.num_rows:
                    void, by = np.append(void, heads.column("ids").flatten().to_numpy()), np.append(by, heads.column("lens").flatten().to_numpy())
                    order = np.argsort(void)
                    void, by = void[order], by[order]
                part = part.slice(heads.num_rows)
                if not part.num_rows:
                    continue
                n, base = part.column("n").to_numpy().astype(np.int64), int(at) << level
                ids, tfs, lens, positions = unpack(n, base, part.column("data"))
                row, keep = np.repeat(np.arange(len(n)), n), np.ones(len(ids), bool)
                if len(void):
                    k = np.minimum(np.searchsorted(void, ids), len(void) - 1)
                    keep = ~((void[k] == ids) & (part.column("gen").to_numpy()[row] < by[k]))
                n = np.bincount(row[keep], minlength=len(n))
                left = pa.array(np.flatnonzero(n))
                n = n[n > 0]
                data = pack(n, base, ids[keep], tfs[keep], lens[keep], positions[np.repeat(keep, tfs)])
                yield pa.RecordBatch.from_arrays([part.column("term").take(left), part.column("piece").take(left), pa.array(n, pa.int32()), data, pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int32()))], names=names)

    return run


def _extent(rows: DataFrame, bytes_: F.Column) -> tuple[int, int]:
    """How far the keys of rows reach, and their bytes."""
    s = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.coalesce(F.sum(bytes_), F.lit(0)).cast("long").alias("bytes")).first()
    return (1 if s["lo"] is None else s["hi"] - s["lo"] + 1), s["bytes"]


def piece_level(span: int, bytes_: int) -> int:
    return min(62, (max(1, -(-span // max(1, bytes_ // PIECE_BYTES))) - 1).bit_length())


class Index:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{name}/gen={g}" for g in generations(self.spark, self.root)]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _spread(self, rows: DataFrame, bytes_: int, *by, ranges: bool = False) -> DataFrame:
        """rows by these columns, in more tasks than a session's shuffle has if they would be large; small ones Spark joins."""
        n, usual = -(-bytes_ // (4 * FILE_BYTES)), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        deal = rows.repartitionByRange if ranges else rows.repartition
        return deal(n, *by) if n > usual else deal(*by)

    def _write(self, gen: int, partials: DataFrame, counts: DataFrame, span: int, bytes_: int, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """A generation of PARTIAL rows, which are shuffled once. counts(term, n) say, about, which terms are many blocks in a piece:
        these few thousand at most get their level before, so that one term is many tasks."""
        to = lambda name: f"{self.root}/{name}/gen={gen}"
        docs.write.mode("overwrite").parquet(to("docs"))
        avg = float(self.spark.read.parquet(to("docs")).agg(F.avg("len")).first()[0] or 1.0)
        least, width = levels_from(span), piece_level(span, bytes_)
        level = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in least]), lambda x: x > F.col("df")))
        often = counts.where("n >= 16").groupBy("term").agg(F.sum("n").alias("df")).select("term", level.alias("level")).where(F.col("level") < width)
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        slice_ = F.pmod(F.xxhash64(F.lit(1), "term", F.when(F.col("level").isNotNull(), F.col("piece"))), F.lit(1 + bytes_ // (self.buckets * FILE_BYTES)))
        rows = self._spread(partials.select("term", "piece", "n", "data").join(F.broadcast(often), "term", "left"), bytes_, bucket, slice_).sortWithinPartitions("term", "piece")
        rows = rows.withColumn("bucket", bucket).mapInArrow(_blocked(least, avg, width), "term string, level int, range long, n int, best double, avg double, ids array<bigint>, tfs array<int>, lens array<int>, positions array<array<int>>, bucket int")
        rows.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(to("blocks"))
        kind = "term string, level int, n int"
        self.spark.read.schema(kind).parquet(to("blocks")).groupBy("term").agg(F.sum("n").alias("df"), F.max("level").alias("level")).write.mode("overwrite").parquet(to("terms"))
        dead = self.spark.read.parquet(to("docs")).select("key")
        if removed is not None:
            dead = dead.unionByName(removed).distinct()
        (dead if gen else dead.where("false")).write.mode("overwrite").parquet(to("dead"))

    def add(self, docs: DataFrame, removed: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> "Index":
        """A generation of docs, which replace documents of equal ids; removed(key) names ids that go. Texts are shuffled once,
        by ranges of ids, and their postings written once before they are shuffled to blocks."""
        gen = (generations(self.spark, self.root) or [-1])[-1] + 1
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        span, bytes_ = _extent(rows, F.octet_length("text"))
        rows = self._spread(rows, bytes_, "key", ranges=True).sortWithinPartitions("key", F.desc("text")).select("key", tokens("text").alias("t"))
        at = f"{self.root}/postings/gen={gen}"
        rows.mapInArrow(_inverted(piece_level(span, bytes_)), PARTIAL).write.mode("overwrite").option("compression", "zstd").parquet(at)
        partials = self.spark.read.schema(PARTIAL).parquet(at)
        docs = partials.where("term IS NULL").select(F.explode(F.arrays_zip("ids", "lens")).alias("x")).select(F.col("x.ids").alias("key"), F.col("x.lens").alias("len"))
        if removed is not None:
            removed = removed.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL")
        partials = partials.where("term IS NOT NULL")
        self._write(gen, partials, partials.select("term", "n"), span, bytes_, docs, removed)
        path, fs = _fs(self.spark, at)
        fs.delete(path, True)
        return self

    def _void(self) -> DataFrame:
        """key, by: from the generation `by` on, older entries of key don't count."""
        return self._read("dead").groupBy("key").agg(F.max("gen").alias("by"))

    def documents(self) -> DataFrame:
        """key, len of the documents that count."""
        docs, gens = self._read("docs"), generations(self.spark, self.root)
        if len(gens) == 1:
            return docs.select("key", "len")
        return docs.alias("d").join(self._void().alias("v"), F.expr("d.key = v.key AND d.gen < v.by"), "left_anti").select("key", "len")

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of terms: only their buckets' folders are opened, and there by statistics the row groups that hold them."""
        ids = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")).collect()]
        return self._read("blocks").where(F.col("bucket").isin(sorted(set(ids))) & F.col("term").isin(terms))

    def postings(self, blocks: DataFrame, *more: str) -> DataFrame:
        """term, key, tf, len (and positions) of the documents of blocks() that count."""
        each = F.explode(F.arrays_zip("ids", "tfs", "lens", *more)).alias("x")
        rows = blocks.select("gen", "term", F.expr("shiftleft(range, level)").alias("first"), each)
        rows = rows.select("gen", "term", (F.col("first") + F.col("x.ids")).alias("key"), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"), *[F.col(f"x.{m}").alias(m) for m in more])
        if len(generations(self.spark, self.root)) > 1:
            rows = rows.alias("p").join(self._void().alias("v"), F.expr("p.key = v.key AND p.gen < v.by"), "left_anti")
        return rows.select("term", "key", "tf", "len", *more)

    def merged(self, root: str) -> "Index":
        """The same documents as one generation at another root, from postings alone. They meet the void ids by ranges of ids,
        a term's postings of a range in one row."""
        docs = self.documents()
        span, bytes_ = _extent(docs, F.lit(6) * F.col("len"))
        level = piece_level(span, bytes_)
        rows = self._read("blocks").select("gen", "term", F.expr("shiftleft(range, level)").alias("first"), "ids", "tfs", "lens", "positions").mapInArrow(_pieces(level), f"gen int, {PARTIAL}")
        if len(generations(self.spark, self.root)) > 1:
            void = self._void().groupBy(F.shiftright("key", level).alias("piece")).agg(F.collect_list(F.struct("key", "by")).alias("x"))
            void = void.select(F.lit(0).alias("gen"), F.lit(None).cast("string").alias("term"), "piece", F.size("x").alias("n"), F.lit(None).cast("binary").alias("data"), F.col("x.key").alias("ids"), F.col("x.by").alias("lens"))
            rows = self._spread(rows.unionByName(void), bytes_, "piece").sortWithinPartitions("piece", F.col("term").asc_nulls_first()).mapInArrow(_alive(level), PARTIAL)
        out = Index(self.spark, root, self.buckets)
        out._write(0, rows, self._read("terms").select("term", F.col("df").alias("n")), span, bytes_, docs)
        return out

    def _frequencies(self, terms: list[str]) -> dict[str, int]:
        """Documents that count, by term: a row a term."""
        if len(generations(self.spark, self.root)) == 1:
            return {r["term"]: r["df"] for r in self._read("terms").where(F.col("term").isin(terms)).select("term", "df").collect()}
        return {r["term"]: r["n"] for r in self.postings(self.blocks(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}

    def top_k(self, terms: list[str], k: int = 20, key: str = "doc_id") -> DataFrame:
        """key, score as search() gives them."""
        return self.scored(self.surviving(terms, k), key).orderBy(F.desc("score"), key).limit(k)

    def _rarity(self) -> F.Column:
        """The factor of a row's term, from the query's few terms."""
        n, out = self._stats[0], F.lit(0.0)
        for t, df in self._df.items():
            out = F.when(F.col("term") == t, F.log(F.lit(1.0) + (F.lit(n) - F.lit(df) + 0.5) / (F.lit(df) + F.lit(0.5)))).otherwise(out)
        return out

    def _impact(self) -> F.Column:
        """What a posting adds to its document's score."""
        return self._rarity() * weight(F.col("tf"), F.col("len"), F.lit(self._stats[1]))

    def surviving(self, terms: list[str], k: int) -> DataFrame:
        """The blocks that may hold one of the k best documents."""
        terms = sorted({t.lower() for t in terms})
        s = self.documents().agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
        self._stats, self._df = (int(s["n"]), float(s["a"] or 1.0)), self._frequencies(terms)
        blocks = self.blocks(terms)
        heads = blocks.select("gen", "term", "level", "range", (self._rarity() * F.col("best") * F.greatest(F.lit(1.0), F.lit(self._stats[1]) / F.col("avg"))).alias("bound"))
        bounds = None
        levels = {(r["gen"], r["term"]): r["level"] for r in self._read("terms").where(F.col("term").isin(terms)).select("gen", "term", "level").collect()}
        for (g, t), level in levels.items():
            mine = heads.where((F.col("gen") == g) & (F.col("term") == t))
            for other in terms:
                there = [(h, levels[h, other]) for h, u in levels if u == other and h == g]
                if other == t or not there:
                    continue
                up = there[0][1]
                # Ranges of powers of two nest: the coarser one is found by a shift.
                theirs = heads.where((F.col("gen") == g) & (F.col("term") == other)).groupBy(F.shiftright("range", max(0, level - up)).alias("_at")).agg(F.max("bound").alias("_more"))
                mine = mine.withColumn("_at", F.shiftright("range", max(0, up - level))).join(theirs, "_at", "left").withColumn("bound", F.col("bound") + F.coalesce("_more", F.lit(0.0))).drop("_at", "_more")
            bounds = mine if bounds is None else bounds.unionByName(mine)
        if bounds is None:
            return blocks.where("false")
        best = F.broadcast(bounds.orderBy(F.desc("bound")).limit(PROBES).select("gen", "term", "range"))  # PROBES rows
        probed = self.postings(blocks.join(best, ["gen", "term", "range"])).select("key", self._impact().alias("s")).groupBy("key").agg(F.max("s").alias("s"))
        least = probed.orderBy(F.desc("s")).limit(k).agg(F.when(F.count("*") >= k, F.min("s")).alias("least")).first()["least"]
        if least is None:
            return blocks
        return blocks.join(bounds.where(F.col("bound") >= least - SLACK).select("gen", "term", "range"), ["gen", "term", "range"], "left_semi")

    def scored(self, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
        p = self.postings(blocks).select("key", self._impact().alias("s"))
        return p.groupBy(F.col("key").alias(key)).agg(F.round(F.sum("s"), 6).alias("score"))

    def occurrences(self, terms: list[str]) -> DataFrame:
        """term, key, pos (in tokens, from 0)."""
        p = self.postings(self.blocks(sorted(set(terms))), "positions")
        return p.select("term", "key", F.explode("positions").alias("pos"))

    def phrase(self, words: str, key: str = "doc_id") -> DataFrame:
        """key, start: where the words stand one behind the other, in tokens. Occurrences are shifted back by their place in
        the phrase and joined on document and start, the rarest word first."""
        terms = words.lower().split()
        df = self._frequencies(sorted(set(terms)))
        out = None
        for i in sorted(range(len(terms)), key=lambda i: (df.get(terms[i], 0), i)):
            at = self.occurrences([terms[i]]).select(F.col("key").alias(key), (F.col("pos") - i).alias("start"))
            out = at if out is None else out.join(at, [key, "start"])
        return out

    def windows(self, terms: list[str], key: str = "doc_id") -> DataFrame:
        """key, start, end: the shortest run of tokens (half-open) that holds all terms, the first of equal ones, in each
        document that has them all."""
        terms = sorted({t.lower() for t in terms})
        upto = Window.partitionBy("key").orderBy("pos")
        at = self.occurrences(terms)
        lasts = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(upto) for t in terms]
        spans = at.select("key", "pos", F.array(*lasts).alias("l")).where(F.forall("l", lambda x: x.isNotNull())).select("key", F.array_min("l").alias("start"), (F.col("pos") + 1).alias("end"))
        best = spans.groupBy(F.col("key").alias(key)).agg(F.min(F.struct(F.col("end") - F.col("start"), F.col("start"), F.col("end"))).alias("b"))
        return best.select(key, F.col("b.start").alias("start"), F.col("b.end").alias("end"))
