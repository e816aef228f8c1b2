"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model file is read into flat arrays: for every pair of symbols whose concatenation is a piece, the merged piece and its
rank (the order of scores, best first). Texts are cut where no piece can reach across: before a run of word marks, and
around characters that no piece holds next to each other. The distinct words of a batch then lie in one flat symbol array;
each round looks up all neighbouring pairs, takes in every word the pair of least rank, leftmost on ties (a segmented
minimum), from round PLAIN on also every further pair that the library is sure to merge whatever comes before it (see
PieceModel._sure), merges all of these at once and compacts the array; words without a mergeable pair leave it. So the
result is exactly that of the library, which merges one pair after another, and words of any length take few rounds.

Covered: BPE models with the identity normaliser, a dummy prefix, kept white space and byte fallback; others are refused.
Defined results: null and empty texts have no ids and decode to the empty text; texts are never cut short, and a very long
word takes about 170 bytes a character while it is merged; pairs of equal rank merge from the left; repeated rows are encoded
each for itself, with equal results; an empty table gives no rows. Only the named columns are read, so extra columns may have
any name.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import map_batches, powers_to, table

MARK = "▁"
#: Rounds of one merge a word: most words end in them, for less than the search for further pairs costs.
PLAIN = 8
#: Words a task keeps, in all; about 400 bytes each.
CACHE = 500_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: The rank of a pair that is no piece.
NO_RANK = np.int64(np.iinfo(np.int32).max)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class PieceModel:
    def __init__(self, data: bytes):
        pieces, normal, trainer = [], {}, {}
        for k, v in _fields(data):
            if k == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), float(np.frombuffer(d.get(2, b"\0\0\0\0"), "<f4")[0]), d.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or any(t not in (NORMAL, UNKNOWN, 3, BYTE) for _, _, t in pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are covered")
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.pieces, self.size = pieces, len(pieces)
        self.texts = [p.replace(MARK, " ") if t == NORMAL else None for p, _, t in pieces]
        self.letter = ids["a"]
        #: Characters that are no piece but occur in one get symbols of their own; any other character is NONE.
        chars = sorted({c for p in ids for c in p} - ids.keys())
        symbol = {**ids, **{c: self.size + i for i, c in enumerate(chars)}}
        self.none = self.size + len(chars)
        self.of_char = np.full(0x110000, self.none, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        scores = np.array([-s for _, s, _ in pieces])
        rank = np.unique(scores, return_inverse=True)[1]
        pairs = sorted((symbol[p[:k]] * (self.none + 1) + symbol[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_to = np.array([i for _, i in pairs] + [-1], np.int32)
        self.rank = np.append(rank, NO_RANK).astype(np.int64)  # rank[-1] belongs to "no pair"
        #: Ranks of pieces by a hash of their text. Where hashes meet the best rank counts, so _sure() errs on the safe side.
        self.longest = max(map(len, ids))
        codes = np.zeros((len(ids), self.longest), np.uint64)
        for row, p in zip(codes, ids):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32) + np.uint64(1)
        keys = (codes * powers_to(self.longest)[0]).sum(1, dtype=np.uint64)
        order = np.lexsort((rank[list(ids.values())], keys))
        first = np.append(True, np.diff(keys[order]) != 0)
        self.text_keys = np.append(keys[order][first], np.uint64(np.iinfo(np.uint64).max))
        self.text_rank = np.append(rank[list(ids.values())][order][first], NO_RANK).astype(np.int64)
        #: Code point pairs that stand next to each other in some piece.
        self.touching = np.unique(np.array([(ord(a) << 21) | ord(b) for p in ids for a, b in zip(p, p[1:])], np.int64))
        self.whole_lines = any("\n" in p for p in ids)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_to[at], -1)

    def ids_of(self, symbols, chars: str) -> list[int]:
        """Final symbols to ids. chars: the characters of those symbols that are no piece, in order."""
        out, k = [], 0
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [self.bytes_at[b] for b in chars[k].encode("utf-8", "surrogatepass")]
                k += 1
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are already cut from their texts, with marks in place of spaces."""
        out: list = [None] * len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        symbols = self.of_char[points]
        # Cut words where no piece holds both neighbours: each part is merged for itself.
        joined = np.isin((points[:-1].astype(np.int64) << 21) | points[1:], self.touching) & (owner[:-1] == owner[1:]) if len(points) else np.zeros(0, bool)
        part = np.concatenate([[0], np.cumsum(~joined)]) if len(points) else np.zeros(0, np.int64)
        final = self._merge(symbols, part, points)
        ends = np.searchsorted(owner[final[1]], np.arange(len(words) + 1))
        flat, start = final[0].tolist(), np.concatenate([[0], np.cumsum(lengths)])
        for i, w in enumerate(words):
            got = flat[ends[i] : ends[i + 1]]
            if got and max(got) >= self.size:
                at = final[1][ends[i] : ends[i + 1]] - start[i]
                got = self.ids_of(got, [w[p] for p, x in zip(at.tolist(), got) if x >= self.size])
            out[i] = got
        return out

    def _merge(self, symbols: np.ndarray, part: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and where each began, in text order."""
        n = len(symbols)
        if not n:
            return symbols, np.zeros(0, np.int64)
        up, down = powers_to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        done_s, done_p = [], []
        sym, at, seg = symbols, np.arange(n), part
        end = at + 1
        to = np.full(n, -1, np.int32)
        same = seg[:-1] == seg[1:]
        to[:-1][same] = self.merged(sym[:-1][same], sym[1:][same])
        turn = 0
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            rank = self.rank[to]
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), heads)
            live = (best >> 32) < NO_RANK
            if not live.all():
                gone = np.repeat(~live, np.diff(np.append(heads, len(sym))))
                done_s.append(sym[gone])
                done_p.append(at[gone])
                stay = ~gone
                where = np.cumsum(stay) - 1
                best = where[best[live] & 0xFFFFFFFF]
                sym, at, end, seg, to, rank = sym[stay], at[stay], end[stay], seg[stay], to[stay], rank[stay]
                if not len(sym):
                    break
            else:
                best = best & 0xFFFFFFFF
            turn += 1
            if turn > PLAIN:
                best = self._sure(best, sym, rank, seg, at, end, sums, down)
            sym[best], end[best] = to[best], end[best + 1]
            stay = np.ones(len(sym), bool)
            stay[best + 1] = False
            where = np.cumsum(stay) - 1
            best = where[best]
            sym, at, end, seg, to = sym[stay], at[stay], end[stay], seg[stay], to[stay]
            for p in (best, best[best > 0] - 1):  # only pairs beside a merge are new
                to[p] = -1
                p = p[p + 1 < len(sym)]
                p = p[seg[p] == seg[p + 1]]
                to[p] = self.merged(sym[p], sym[p + 1])
        s, p = np.concatenate(done_s), np.concatenate(done_p)
        order = np.argsort(p, kind="stable")
        return s[order], p[order]

    def _sure(self, best, sym, rank, seg, at, end, sums, down) -> np.ndarray:
        """best, and the pairs that the library will merge whatever it merges before, and that change nothing if merged now:
        symbols only grow, so whatever may reach into a pair, or take in what it becomes, is a run of symbols from its
        neighbourhood, and none of these is a piece of the pair's rank or a better one. In a run of one symbol, which merges
        from its left, every second pair is sure as long as those before it are."""
        n = len(sym)
        ok = np.zeros(n, bool)
        ok[1:] = rank[1:] < rank[:-1]
        ok[0] = rank[0] < NO_RANK
        ok[:-1] &= rank[:-1] < rank[1:]
        twin = np.zeros(n, bool)
        np.logical_and(sym[:-1] == sym[1:], rank[:-1] < NO_RANK, out=twin[:-1])
        runs = bool((twin[:-1] & twin[1:]).any())
        if runs:
            place, first = np.arange(n), twin.copy()
            first[1:] &= ~twin[:-1]
            starts = np.maximum.accumulate(np.where(first, place, -1))
            even = twin & ((place - starts) % 2 == 0)
            tied = even & ~first  # with the pair before; and with the one after, if that is a twin too
            before, after = np.append(NO_RANK, rank[:-1]), np.append(rank[1:], NO_RANK)
            ok = np.where(twin, even & (tied | (before > rank)) & ((after > rank) | np.append(twin[1:], False)), ok)
        ok[best] = False
        c = np.flatnonzero(ok)
        ok[best] = True
        if not len(c):
            return best

        def ranks(lo, hi):
            keys = (sums[hi] - sums[lo]) * down[lo]
            k = np.searchsorted(self.text_keys, keys)
            return np.where(self.text_keys[k] == keys, self.text_rank[k], NO_RANK)

        for way in (-1, 1):
            near, far = (c, c + 1) if way < 0 else (c + 1, c)  # the symbol that is reached first, the other one
            left = np.arange(len(c))  # pairs that are still to be looked at
            for k in range(1, self.longest):
                x = near[left] + way * k
                left, x = (y[(x >= 0) & (x < n)] for y in (left, x))
                reach = (end[near[left]] - at[x] if way < 0 else end[x] - at[near[left]]) <= self.longest
                inside = reach & (seg[x] == seg[c[left]]) & ok[c[left]]
                left, x = left[inside], x[inside]
                if not len(left):
                    break
                r = rank[c[left]]
                for other in (near, far):
                    lo, hi = (at[x], end[other[left]]) if way < 0 else (at[other[left]], end[x])
                    short = np.flatnonzero(hi - lo <= self.longest)
                    got = ranks(lo[short], hi[short])
                    bad = got <= r[short]
                    if runs and k == 1 and other is near:
                        i = c[left[short]]
                        bad &= (got < r[short]) | ~(tied[i] if way < 0 else twin[i] & twin[i + 1])
                    ok[c[left[short[bad]]]] = False
        if runs:
            broken = np.maximum.accumulate(np.where(even & ~ok, place, -1))
            ok &= ~twin | (broken < starts)
        return np.flatnonzero(ok)

    def decode_inner(self, ids) -> str:
        """decode() of ids that don't begin a text, whose dummy prefix stays."""
        try:
            return "".join([self.texts[i] for i in ids])
        except TypeError:  # a byte
            return self.decode([self.letter, *ids])[1:]

    def decode(self, ids) -> str:
        """Pieces joined, marks as spaces, without the dummy prefix; bytes that are no UTF-8 give U+FFFD each."""
        out, run, first = [], bytearray(), True

        def flush():
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]

        for i in ids:
            p, _, t = self.pieces[i]
            if t == BYTE:
                run.append(int(p[3:5], 16))
            else:
                flush()
                if t == UNKNOWN:
                    out.append(" ⁇ ")
                elif t == NORMAL:
                    out.append((p[1:] if first and p.startswith(MARK) else p).replace(MARK, " "))
            first = first and t not in (NORMAL, UNKNOWN, BYTE)
        flush()
        return "".join(out)


@lru_cache(4)
def model_of(data: bytes) -> PieceModel:
    return PieceModel(data)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def shipped(docs: DataFrame, path: str):
    """The model, under 1 MB, for executors that can't see the driver's files."""
    return docs.sparkSession.sparkContext.broadcast(model_bytes(path))


class Encoder:
    """Whole texts to ids, over a bounded cache of words. What is cached of a word: how many ids, these as text, and
    their decoded bytes."""

    def __init__(self, model: str | bytes):
        self.model = model_of(model_bytes(model) if isinstance(model, str) else model)
        self.spaced: dict = {}  # words after one space, without it
        self.bare: dict = {}  # anything else, spaces in place
        self.newline = self._entries(["\n"])[0]

    def _entries(self, words):
        got = self.model.encode_words([w.replace(" ", MARK) for w in words])
        return [(len(x), ",".join(map(str, x)), self.model.decode_inner(x)) for x in got]

    def cut(self, text: str) -> list[tuple[bool, list[str]]]:
        """Runs of words of one cache, in text order; None stands for a newline."""
        if not text:
            return []
        out: list = []
        lines = [text] if self.model.whole_lines else text.split("\n")
        for k, line in enumerate(lines):
            if k:
                out.append((None, None))
            if k == 0:
                line = " " + line
            line = line.replace(MARK, " ")
            words = line.split(" ")
            if "" in words[1:]:
                out.append((False, re.findall(r" +[^ ]*|[^ ]+", line)))
            else:
                if words[0]:
                    out.append((False, words[:1]))
                if len(words) > 1:
                    out.append((True, words[1:]))
        return out

    def batch(self, texts) -> list[list[tuple[int, str, str]]]:
        """For each text its words' entries."""
        cuts = [self.cut(t or "") for t in texts]
        for kind, cache in ((True, self.spaced), (False, self.bare)):
            words = set().union(*[w for c in cuts for k, w in c if k is kind])
            new = [w for w in words if w not in cache]
            if len(self.spaced) + len(self.bare) + len(new) > CACHE:
                cache.clear()
                new = list(words)
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                cache.update(zip(part, self._entries([" " + w for w in part] if kind else part)))
        spaced, bare, line = self.spaced, self.bare, [self.newline]
        out = []
        for c in cuts:
            entries: list = []
            for kind, words in c:
                entries += line if kind is None else map((spaced if kind else bare).__getitem__, words)
            out.append(entries)
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, s, _ in self.batch([text])[0] for i in s.split(",")]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, decoded of every row: the ids of the whole text and the text decoded from them."""

    model = shipped(docs, model_path)

    def make():
        e = Encoder(model.value)

        def f(b):
            got = e.batch(b[text])
            return {key: b[key], "ids": [[int(i) for _, s, _ in x for i in s.split(",")] for x in got], "decoded": ["".join(d for _, _, d in x)[1:] for x in got]}

        return f

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(key, text), make, f"{key} {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key, columns to carry, n_tokens, ids_sha256, decoded_sha256: encode() without shipping ids, for tables where only
    digests count."""
    keep = [key, *(carry or [])]

    model = shipped(docs, model_path)

    def make():
        e = Encoder(model.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def f(b):
            got = e.batch(b[text])
            return {c: b[c] for c in keep} | {"n_tokens": [sum([x[0] for x in g]) for g in got], "ids_sha256": [sha(",".join([x[1] for x in g])) for g in got], "decoded_sha256": [sha("".join([x[2] for x in g])[1:]) for g in got]}

        return f

    kinds = dict(docs.dtypes)
    return map_batches(docs.select(*keep, text), make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_model())
