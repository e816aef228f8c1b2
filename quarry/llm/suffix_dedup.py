"""Suffix-array dedup by bucket-pointer refinement: remove each byte covered by a LENGTH-byte string that also starts in a
document with a smaller id.

Sorting all suffixes of a corpus would shuffle many times its size, so suffixes are first sieved by anchors. The anchor of
a LENGTH-byte window is the least hash among its GRAM-byte substrings. Consecutive windows with one anchor value form a run
(about 6 in 100 positions begin one); equal windows have equal anchor values, so only windows of one value can be equal.

1. Runs are keyed by anchor value and by a hash of all their bytes, packed into one binary row per chunk of text and
   partition, and shuffled by anchor value. A run whose bytes also occur in a smaller document is covered as a whole; of an
   anchor value with several different runs, one run each is left open. Within a chunk, only the smallest document's copy
   of a run is sent: a passage in a third of all documents is one record a chunk.
2. The bytes of open runs are sent to their anchor's partition and their windows compared exactly. GRAM8-byte strings give
   the initial buckets; a bucket is refined by the bucket at a later offset (i + 8 for 16 bytes, i + 16 for 32, i + 18
   for LENGTH), each round reusing the numbers that the round before gave to all suffixes, and only suffixes that still
   share a bucket are sorted. A window covered by a smaller document of its chunk is settled there, before the shuffle.
   An anchor in HOT_ROWS documents or more would still gather all their boundaries in one task. Such anchors are counted in
   a sample that grows with the corpus (it steers only the routing, never a result); their runs are dealt by content, and
   those of their windows that a chunk leaves open are sent one by one, dealt by a hash of the window.
3. Covered windows meet their documents again by id and a 64-bit digest of the text, once, so rows of one id, or without
   one, get their own; spans are merged, and the bytes that remain are kept.

The text is shuffled once: the exchange that feeds step 2 is reused by step 3. Run keys have 100 bits or more; a false
match of whole runs needs equal keys, and step 2 compares bytes. A partition holds about PART_BYTES of text, so there are
more of them the larger the corpus is.

Defined results: null text is empty; texts below LENGTH bytes keep every byte; a null id counts as larger than all others;
rows of one id never cover each other (a string's ties among rows of its smallest id leave it in all of them); repeated rows
get equal results; an empty table gives no rows. Texts of any length are read whole, long ones in pieces that overlap by
LENGTH - 1 bytes. repeats() reads key and text only; cleaned() returns the columns of docs, whatever they are called. Ids are integers, as
their order decides; a table with other ids is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BATCH_ROWS, ODD, give_back, integral, materialise, mix_bits, powers_to, prepare_python, quoted, slices, table

LENGTH = 50
GRAM = 20
#: Bytes of text whose runs are packed together.
CHUNK = 4 << 20
#: Open runs of one anchor in a chunk from which on the chunk compares their windows itself.
OFTEN = 8
#: Bytes of text hashed at once.
BLOCK = 1 << 19
#: Bytes of text for each partition of the shuffles, at most, on average.
PART_BYTES = 16 << 20
LAST = (1 << 63) - 1
#: An anchor that about so many documents hold is hot. One document in HOT_ROWS / HOT_SEEN is looked at to find them.
HOT_ROWS = 1 << 17
HOT_SEEN = 64
#: A byte of text is at most 1 / 16 of an anchor, so more than 1 / (16 * rows) of the bytes can't be hot anchors: with a row
#: for each HOT_BYTES bytes, under a million are (the sample counts an anchor as hot from half of that on).
HOT_BYTES = 1 << 17

_KEY = (1 << 40) - 1


NONE = {"doc": np.zeros(0, np.int64), "run": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "windows": np.zeros(0, np.int64), "anchor": np.zeros(0, np.uint64), "bytes": np.zeros(0, np.uint64)}


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The runs of some texts in order: doc (index), run (index in the document), start, windows (first window and how
    many), anchor, bytes (hash of all bytes under the windows)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(size.sum())
    if n < LENGTH:
        return NONE
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    up, down = powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    low = mix_bits((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    span, k = LENGTH - GRAM + 1, 1
    while 2 * k <= span:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if k < span:
        low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
    m = len(low)
    inside = owner[:m] == owner[LENGTH - 1 :]
    head = np.ones(m, bool)
    head[1:] = (low[1:] != low[:-1]) | (owner[1:m] != owner[: m - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], m)
    keep = inside[first]
    first, last = first[keep], last[keep]
    doc = owner[first].astype(np.int64)
    begin = np.cumsum(size) - size
    windows = last - first
    return {
        "doc": doc, "run": np.arange(len(first)) - np.searchsorted(doc, doc), "start": first - begin[doc], "windows": windows, "anchor": low[first],
        "bytes": mix_bits((sums[last + LENGTH - 1] - sums[first]) * down[first] + windows.astype(np.uint64)),
    }


def blocks_of(texts: list[bytes]):
    """(index of the first text, offset in it, texts) of blocks of about BLOCK bytes. A long text comes in pieces, alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        if len(t) > 2 * BLOCK:
            if lo < i:
                yield lo, 0, texts[lo:i]
            for at in range(0, len(t) - LENGTH + 1, BLOCK):
                yield i, at, [t[at : at + BLOCK + LENGTH - 1]]
            lo, total = i + 1, 0
            continue
        total += len(t)
        if total >= BLOCK:
            yield lo, 0, texts[lo : i + 1]
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, 0, texts[lo:]


def runs_in_blocks(texts: list[bytes]) -> dict[str, np.ndarray]:
    """runs() of texts of any length. Where a long text's pieces meet a run ends: what matters is only that a document's
    runs depend on its text alone."""
    got = [r | {"doc": r["doc"] + lo, "start": r["start"] + at} for lo, at, part in blocks_of(texts) if len((r := runs(part))["doc"])]
    if not got:
        return NONE
    out = {k: np.concatenate([g[k] for g in got]) for k in NONE}
    out["run"] = np.arange(len(out["doc"])) - np.searchsorted(out["doc"], out["doc"])
    return out


def part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    # Anchors are minima, so their own leading bits are mostly zero: they are mixed again to spread evenly.
    return ((mix_bits(anchor) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def settle(group: np.ndarray, content: np.ndarray, doc: np.ndarray, hot: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records (group, content, doc): which are covered (their content also in a smaller doc), which is the first of
    its content (a smallest doc's), and which of the first are open (other contents in the group, from two docs or more; or
    hot, as other contents are then elsewhere)."""
    covered, first, open_ = (np.zeros(len(doc), bool) for _ in range(3))
    if not len(doc):
        return covered, first, open_
    o = np.lexsort((doc, content, group))
    g, c, d = group[o], content[o], doc[o]
    new_g = np.append(True, g[1:] != g[:-1])
    new_c = new_g | np.append(True, c[1:] != c[:-1])
    heads = np.flatnonzero(new_c)
    covered[o] = d > np.repeat(d[heads], np.diff(np.append(heads, len(d))))
    first[o] = new_c
    heads = np.flatnonzero(new_g)
    of = np.cumsum(new_g) - 1
    many = (np.bincount(of, new_c) > 1) & (np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads))
    open_[o] = new_c & many[of]
    open_ |= first & hot
    return covered, first, open_


def refine(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number for each suffix of data, equal for two suffixes if and only if their first LENGTH bytes are equal; -1
    where fewer than LENGTH bytes are left of the suffix's own string (left)."""
    n = len(data)
    small = np.int32 if n < 1 << 31 else np.int64
    number = np.full(n, -1, small)
    at = np.flatnonzero(left >= 8).astype(small)
    if not len(at):
        return number
    key = np.zeros(len(at), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | data[at + k]
    number[at] = np.unique(key, return_inverse=True)[1]
    del key
    size = 8
    for step in (8, 16, LENGTH - 32):  # 16, 32 and LENGTH bytes
        size += step
        shared = np.bincount(number[number >= 0]) > 1
        at = np.flatnonzero(left >= size).astype(small)
        alone = ~shared[number[at]]
        live = at[~alone]
        after = np.full(n, -1, small)
        # A bucket of one stays one: only suffixes that share a bucket are sorted again.
        pair = number[live].astype(np.int64) * (n + 1) + number[live + step]
        ids = np.unique(pair, return_inverse=True)[1] if len(live) else np.zeros(0, np.int64)
        after[live] = ids
        after[at[alone]] = (ids.max() + 1 if len(ids) else 0) + np.arange(int(alone.sum()))
        number = after
    return number


def compare(strings: list[bytes], doc: np.ndarray) -> list[np.ndarray]:
    """For each string of a document, which of its windows are covered by a smaller document's among the strings."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(size)
    small = np.int32 if len(data) < 1 << 31 else np.int64
    left = np.repeat(end.astype(small), size) - np.arange(len(data), dtype=small)
    number = refine(data, left)
    at = np.flatnonzero(number >= 0)
    owner = np.repeat(np.arange(len(strings), dtype=small), size)[at]
    covered, _, _ = settle(number[at], np.zeros(len(at), np.int8), doc[owner])
    return np.split(covered, np.searchsorted(owner, np.arange(1, len(strings))))


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def equal_runs(r: dict, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, k): every run of a document that has the bytes of chosen[k], itself included. A verdict on one of a
    document's equal runs holds for all, so only one of them is sent."""
    key = mix_bits(r["anchor"] * ODD ^ r["bytes"])
    order = np.argsort(key, kind="stable")
    lo, hi = (np.searchsorted(key[order], key[chosen], side) for side in ("left", "right"))
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return order[at], np.repeat(np.arange(len(chosen)), n)


def sliced(batches):
    for b in batches:
        yield from slices(b, BATCH_ROWS)


def frugal(run):
    """run, giving memory back when its task ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def _rows(schema, **columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


ROUTED = "part int, id long, digest long, blob binary"
VERDICT = "id long, digest long, blob binary"


def _verdicts(ids: np.ndarray, digests: np.ndarray, values: np.ndarray):
    """(id, digest, blob) for each document of some flagged values."""
    o = np.lexsort((digests, ids))
    i, c, v = ids[o], digests[o], values[o]
    heads = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (c[1:] != c[:-1]))) if len(i) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(i))
    return i[heads].tolist(), c[heads].tolist(), [v[a:b].tobytes() for a, b in zip(heads.tolist(), ends.tolist())]


def pack_runs(slots: list[int], hot: np.ndarray):
    """Texts to packed runs. slots: the value of `part` that a partition's rows carry; hot: the hot anchors."""
    parts, schema = len(slots), _schema(ROUTED)

    def run(batches):
        kept, docs, digests, total = [], [], [], 0

        def flush():
            r = {k: np.concatenate([x[k] for x in kept]) for k in ("doc", "run", "anchor", "bytes")}
            id_, digest = np.array(docs, np.int64), np.array(digests, np.int64)
            covered, first, _ = settle(r["anchor"], r["bytes"], id_[r["doc"]])
            is_hot = np.isin(r["anchor"], hot)
            part = part_of(np.where(is_hot, r["bytes"], r["anchor"]), parts) + parts * is_hot  # hot runs in rows of their own
            out_part, out_blob = [], []
            send = np.flatnonzero(first)
            send = send[np.argsort(part[send], kind="stable")]
            cut = np.searchsorted(part[send], np.arange(2 * parts + 1))
            for p in range(2 * parts):
                x = send[cut[p] : cut[p + 1]]
                if not len(x):
                    continue
                used, local = np.unique(r["doc"][x], return_inverse=True)
                kind = np.uint16 if max(len(used), int(r["run"][x].max()) + 1) <= 0xFFFF else np.uint32
                key = (r["anchor"][x] & np.uint64(_KEY)).view(np.uint8).reshape(-1, 8)[:, :5]
                out_part.append(slots[p % parts])
                out_blob.append(b"".join([np.array([len(x), len(used), kind().itemsize, p >= parts], np.int64).tobytes(), id_[used].tobytes(), digest[used].tobytes(), key.tobytes(), r["bytes"][x].tobytes(), local.astype(kind).tobytes(), r["run"][x].astype(kind).tobytes()]))
            none = [None] * len(out_part)
            yield _rows(schema, part=out_part, id=none, digest=none, blob=out_blob)
            x = np.flatnonzero(covered)
            i, c, v = _verdicts(id_[r["doc"][x]], digest[r["doc"][x]], (r["run"][x] << 1).astype(np.uint32))
            yield _rows(schema, part=[slots[k % parts] for k in i], id=i, digest=c, blob=v)

        for b in sliced(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            r = runs_in_blocks(texts)
            kept.append(r | {"doc": r["doc"] + len(docs)})
            docs += b.column(0).to_pylist()
            digests += b.column(2).to_pylist()
            total += sum(map(len, texts))
            if total >= CHUNK:
                yield from flush()
                kept, docs, digests, total = [], [], [], 0
        if docs:
            yield from flush()

    return run


def judge_runs():
    schema = _schema(VERDICT)

    def run(batches):
        doc, digest, group, content, index, hot = [], [], [], [], [], []
        for b in batches:
            for part, i, c, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                if i is not None:
                    yield _rows(schema, id=[i], digest=[c], blob=[blob])
                    continue
                n, used, width, is_hot = np.frombuffer(blob, np.int64, 4).tolist()
                kind, at = (np.uint16 if width == 2 else np.uint32), 32
                ids = np.frombuffer(blob, np.int64, used, at)
                at += 8 * used
                digests = np.frombuffer(blob, np.int64, used, at)
                at += 8 * used
                key = np.zeros((n, 8), np.uint8)
                key[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at).reshape(-1, 5)
                at += 5 * n
                content.append(np.frombuffer(blob, np.uint64, n, at))
                at += 8 * n
                local = np.frombuffer(blob, kind, n, at)
                index.append(np.frombuffer(blob, kind, n, at + width * n).astype(np.uint32))
                group.append(key.view(np.uint64).ravel())
                doc.append(ids[local])
                digest.append(digests[local])
                hot.append(np.full(n, bool(is_hot)))
        if not doc:
            return
        doc, digest, group, content, index, hot = map(np.concatenate, (doc, digest, group, content, index, hot))
        covered, _, open_ = settle(group, content, doc, hot)
        x = np.flatnonzero(covered | open_)
        i, c, v = _verdicts(doc[x], digest[x], (index[x] << np.uint32(1)) | open_[x].astype(np.uint32) * ~covered[x])
        for lo in range(0, len(i), 10_000):
            yield _rows(schema, id=i[lo : lo + 10_000], digest=c[lo : lo + 10_000], blob=v[lo : lo + 10_000])

    return run


def window_hashes(data: bytes) -> np.ndarray:
    n = len(data)
    up, down = powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix_bits((sums[LENGTH:] - sums[:-LENGTH]) * down[: n - LENGTH + 1])


def send_windows(slots: list[int], hot: np.ndarray):
    """Documents with verdicts to the strings under their open runs, less what their own chunk settles."""
    parts, schema = len(slots), _schema(ROUTED)

    def run(batches):
        ids, digests, numbers, values, anchors, strings, total = [], [], [], [], [], [], 0

        def flush():
            id_ = np.array(ids, np.int64)
            # Only what a chunk holds often is worth settling here; it is what would meet in one task.
            _, of, times = np.unique(np.array(values, np.uint64), return_inverse=True, return_counts=True)
            often = np.flatnonzero(times[of] >= OFTEN)
            covered = [np.zeros(len(s) - LENGTH + 1, bool) for s in strings]
            for k, c in zip(often.tolist(), compare([strings[k] for k in often.tolist()], id_[often]) if len(often) else []):
                covered[k] = c
            done: dict = {}
            out: dict = {}
            for k, c in enumerate(covered):
                for a, b in intervals(c):
                    done.setdefault((ids[k], digests[k]), []).extend((numbers[k], a, b))
                if anchors[k] < 0:  # hot
                    at = np.flatnonzero(~c)
                    for a, p in zip(at.tolist(), part_of(window_hashes(strings[k])[at], parts).tolist()):
                        out.setdefault(p, []).append((ids[k], digests[k], numbers[k], a, strings[k][a : a + LENGTH]))
                    continue
                for a, b in intervals(~c):
                    out.setdefault(anchors[k], []).append((ids[k], digests[k], numbers[k], a, strings[k][a : b + LENGTH - 1]))
            rows = list(out.items())
            none = [None] * len(rows)
            blob = [b"".join([np.int64(len(x)).tobytes(), np.array([(*m, len(t)) for *m, t in x], np.int64).tobytes(), *[t for *_, t in x]]) for _, x in rows]
            yield _rows(schema, part=[slots[p] for p, _ in rows], id=none, digest=none, blob=blob)
            keys = list(done)
            yield _rows(schema, part=[slots[i % parts] for i, _ in keys], id=[i for i, _ in keys], digest=[c for _, c in keys], blob=[np.array(done[k], np.int64).tobytes() for k in keys])

        for b in sliced(batches):
            for i, text, c, blobs in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("_id", "_text", "_digest", "_runs"))):
                text = (text or "").encode("utf-8", "surrogatepass")
                total += len(text)
                flags = np.frombuffer(b"".join(blobs), np.uint32)
                flags = np.sort(flags[flags & np.uint32(1) == 1] >> np.uint32(1)).astype(np.int64)
                if len(flags):
                    r = runs_in_blocks([text])
                    values += r["anchor"][flags].tolist()
                    for k, s, w, p in zip(flags.tolist(), r["start"][flags].tolist(), r["windows"][flags].tolist(), np.where(np.isin(r["anchor"][flags], hot), -1, part_of(r["anchor"][flags], parts)).tolist()):
                        ids.append(i)
                        digests.append(c)
                        numbers.append(k)
                        anchors.append(p)
                        strings.append(text[s : s + w + LENGTH - 1])
            if total >= CHUNK:
                yield from flush()
                ids, digests, numbers, values, anchors, strings, total = [], [], [], [], [], [], 0
        if ids:
            yield from flush()

    return run


def judge_windows():
    schema = _schema(VERDICT)

    def run(batches):
        meta, strings = [], []
        for b in batches:
            for part, i, c, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                if i is not None:
                    yield _rows(schema, id=[i], digest=[c], blob=[blob])
                    continue
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                x = np.frombuffer(blob, np.int64, 5 * n, 8).reshape(-1, 5)
                at = 8 + 40 * n
                for size in x[:, 4].tolist():
                    strings.append(blob[at : at + size])
                    at += size
                meta.append(x)
        if not meta:
            return
        meta = np.concatenate(meta)
        covered = compare(strings, meta[:, 0])
        done: dict = {}
        for (i, c, number, s, _), f in zip(meta.tolist(), covered):
            for a, b in intervals(f):
                done.setdefault((i, c), []).extend((number, s + a, s + b))
        keys = list(done)
        for lo in range(0, len(keys), 10_000):
            part = keys[lo : lo + 10_000]
            yield _rows(schema, id=[i for i, _ in part], digest=[c for _, c in part], blob=[np.array(done[k], np.int64).tobytes() for k in part])

    return run


def removed_spans(text: bytes, run_blobs: list[bytes] | None, window_blobs: list[bytes] | None) -> list[tuple[int, int]]:
    """The maximal removed spans of a text."""
    if not run_blobs and not window_blobs:
        return []
    r = runs_in_blocks([text])
    flags = np.frombuffer(b"".join(run_blobs or []), np.uint32)
    at, _ = equal_runs(r, np.unique(flags[flags & np.uint32(1) == 0] >> np.uint32(1)).astype(np.int64))
    x = np.frombuffer(b"".join(window_blobs or []), np.int64).reshape(-1, 3)  # run, first window, end
    also, k = equal_runs(r, x[:, 0])
    lo = np.concatenate([r["start"][at], r["start"][also] + x[k, 1]])
    hi = np.concatenate([r["start"][at] + r["windows"][at], r["start"][also] + x[k, 2]]) + LENGTH - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    heads = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, np.int64)
    return list(zip(lo[heads].tolist(), hi[np.append(heads[1:], len(hi)) - 1].tolist())) if len(lo) else []


def finish(columns: list[str], make, out: str):
    """Documents with all verdicts to rows: make(row of columns, text, spans, kept bytes) gives the values of out."""
    schema = _schema(out)

    def run(batches):
        for b in sliced(batches):
            names = b.schema.names
            data = {n: b.column(k).to_pylist() for k, n in enumerate(names)}
            rows = []
            for k, text in enumerate(data["_text"]):
                text = (text or "").encode("utf-8", "surrogatepass")
                spans = removed_spans(text, data["_runs"][k], data["_windows"][k])
                kept, at = [], 0
                for a, z in spans:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                rows.append(make([data[c][k] for c in columns], text, spans, b"".join(kept)))
            yield _rows(schema, **{f.name: [r[j] for r in rows] for j, f in enumerate(schema)})

    return run


def hot_anchors(source: DataFrame, rows: int | None = None) -> np.ndarray:
    """Anchors that, by a sample of source(_text), `rows` documents (HOT_ROWS) or more hold. Documents are counted by anchor in
    grouped sums; what comes to the driver is the hot ones. As rows grows with the corpus beyond HOT_ROWS * HOT_BYTES bytes
    of text, they stay below a million."""
    rows = HOT_ROWS if rows is None else rows

    def run(batches):
        for b in sliced(batches):
            found = [np.unique(runs_in_blocks([t.encode("utf-8", "surrogatepass")])["anchor"]) for t in b.column(0).to_pylist()]
            yield _rows(schema, anchor=np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    schema = _schema("anchor long")
    share = min(1.0, HOT_SEEN / rows)
    seen = source.select("_text").sample(share, 7).mapInArrow(run, "anchor long")
    hot = seen.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= rows * share / 2).select("anchor").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def slots_for(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning into n sends to n different partitions, so each task gets one part."""
    got: dict = {}
    size = 8 * n + 64
    while len(got) < n:
        for v, p in spark.range(size).select(F.col("id").cast("int").alias("v"), F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p")).groupBy("p").agg(F.min("v").alias("v")).select("v", "p").collect():
            got[p] = v
        size *= 4
    return [got[p] for p in range(n)]


def deduplicate(docs: DataFrame, make, out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, of schema out, for each row of docs: make(values of docs' columns, text, spans, kept bytes)."""
    integral(docs, key)
    spark = docs.sparkSession
    prepare_python(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    slots = slots_for(spark, n)
    keyed = [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_digest")]
    hot = hot_anchors(docs.select(*keyed), max(HOT_ROWS, size // HOT_BYTES))
    packed = docs.select(*keyed).mapInArrow(frugal(pack_runs(slots, hot)), ROUTED).repartition(n, "part")
    of_runs = packed.mapInArrow(frugal(judge_runs()), VERDICT).groupBy("id", "digest").agg(F.collect_list("blob").alias("_runs"))
    of_runs = materialise(of_runs.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "_runs"), "repeat-runs")
    # Both joins read the one exchange of the texts, so they take the same columns of docs.
    rest = [F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(docs.columns) if c != text]
    source = docs.select(*keyed, *rest)
    sent = source.join(of_runs, ["_id", "_digest"]).mapInArrow(frugal(send_windows(slots, hot)), ROUTED).repartition(n, "part")
    of_windows = sent.mapInArrow(frugal(judge_windows()), VERDICT).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_list("blob").alias("_windows"))
    both = source.join(of_runs, ["_id", "_digest"], "left").join(of_windows, ["_id", "_digest"], "left")
    return both.mapInArrow(frugal(finish([f"c_{i}" if c != text else "_text" for i, c in enumerate(docs.columns)], make, out)), out)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end) of every row."""

    def make(row, data, spans, kept):
        return [row[0], len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in spans]]

    return deduplicate(docs.select(key, text), make, f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", key, text)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed bytes gone from text (a character of which a part is removed goes whole) and n_chars, if
    there is one, counted anew."""
    columns = docs.columns
    at, count = columns.index(text), columns.index("n_chars") if "n_chars" in columns else None

    def make(row, data, spans, kept):
        row = list(row)
        if spans:
            row[at] = kept.decode("utf-8", "ignore")
            if count is not None:
                row[count] = len(row[at])
        return row

    return deduplicate(docs, make, ", ".join(f"{quoted(n)} {t}" for n, t in docs.dtypes), key, text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("spans")
