"""Media columns: interleaved document sequences.

parse() reads a page's HTML, with the tolerant scanner of html_extract, into an ordered list of items, text or media reference, each with its position; a reference
has the digest that its src names ("sha256:<hex>") and its caption (figcaption, before or after it, else alt). store keeps
payloads as 8-bit grey PNG files keyed by the payload's digest; features are computed from the stored bytes read back.
resolve() joins references to what the store knows by digest, so that payloads themselves are never shuffled: only digests
and features meet. assemble() puts items back into one array a document, by position.

A digest with a third of all references (copies) is one row of the store's features; the references' side of the join is
not aggregated, so the planner may broadcast or split it. Every row of the store is read back and described, copies too:
to choose one of each first, the payloads would have to be shuffled.

The query makes a page of each document: its whole text is one picture, its last block another, a third is in no store, and
text stands between them in an order that the text's digest decides. What it returns of a document is read off the
assembled items.

Defined results: null or empty text is a payload of 64 zero bytes; null html has no items, and a document without items is
an empty array after assemble(); a reference whose payload is unknown keeps its item with null features; an unclosed
figcaption ends with its figure or the page; of two captions in a figure, the last before a picture, else the first after
it, counts; repeated rows are documents of their own in the query, and share an array in assemble() if their keys are equal;
an empty table gives no rows. Long texts are stored whole, as one image; a task holds a few at a time. Only key and html (or
text) are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialise, table
from quarry.llm.html_extract import TOKEN, attributes

WIDTH = 64
PREFIX = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FEATURE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "sub", "sup", "small", "code", "q", "cite", "mark", "abbr", "time", "br", "wbr"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """(bytes padded with 0 to a positive multiple of WIDTH, length before)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def to_png(data: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples a row, each row unfiltered."""
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of what to_png() wrote; anything else, or a damaged file, is an error."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows")
    return rows[:, 1:].tobytes()


def describe(data: bytes) -> str:
    """Statistics of the samples, and a 64-bit difference hash of the image shrunk to 9 x 8 cells."""
    a = np.frombuffer(data, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    share = share[share > 0]
    image = a.reshape(-1, WIDTH)
    cut = np.linspace(0, len(image), 9).astype(int)
    columns = np.linspace(0, WIDTH, 10).astype(int)
    cells = np.array([[int(image[lo : max(hi, lo + 1), x:y].sum(dtype=np.int64)) / (max(hi - lo, 1) * (y - x)) for x, y in zip(columns, columns[1:])] for lo, hi in zip(cut, cut[1:])])
    bits = "".join("1" if d else "0" for d in (cells[:, 1:] > cells[:, :-1]).ravel())
    return f"mean={a.mean():.4f};std={a.std():.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};rows={len(image)};dhash={int(bits, 2):016x}"


def parse(html: str | None) -> list[dict]:
    """The items of a page in order. Text runs end at block elements and at media; white space is collapsed."""
    items: list[dict] = []
    text: list[str] = []
    figure, caption = None, None  # where the figure's items begin; its caption's parts
    ahead: list[str] = []  # a caption that stands before its media

    def flush():
        s = " ".join(unescape("".join(text)).split())
        text.clear()
        if s:
            items.append({"position": len(items), "kind": "text", "text": s, "digest": None, "caption": None})

    def caption_ends():
        nonlocal caption
        s = " ".join(unescape("".join(caption)).split())
        caption = None
        for x in items[figure if figure is not None else len(items) :]:
            if x["kind"] == "media" and not x["captioned"]:
                x["caption"], x["captioned"] = s, True
        ahead.append(s)

    at, html = 0, html or ""
    while at <= len(html):
        m = TOKEN.search(html, at)
        (text if caption is None else caption).append(html[at : m.start() if m else len(html)])
        if m is None:
            break
        at, tag, closing, a = m.end(), (m[1] or "").lower(), m[0].startswith("</"), {}
        if tag:
            a, at = attributes(html, at)
        if not tag or tag in _INLINE:
            if tag == "br":
                (text if caption is None else caption).append(" ")
            continue
        if tag in ("script", "style", "head") and not closing:
            if caption is None:
                flush()
            end = re.compile(r"</head(?=[\s/>])[^>]*>?|(?=<body[\s/>])" if tag == "head" else rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "figcaption":
            if caption is not None:
                caption_ends()
            if not closing:
                flush()
                caption = []
            continue
        if caption is not None:
            if tag != "figure" and (closing or tag not in _MEDIA):  # blocks within a caption are its words
                caption.append(" ")
                continue
            caption_ends()
        flush()
        if tag == "figure":
            figure = None if closing else len(items)
            ahead.clear()
        elif tag in _MEDIA and not closing:
            src = a.get("src", "")
            if src.startswith(PREFIX):
                before = figure is not None and bool(ahead)
                items.append({"position": len(items), "kind": "media", "text": None, "digest": src[len(PREFIX) :].lower(), "caption": ahead[-1] if before else a.get("alt"), "captioned": before})
    if caption is not None:
        caption_ends()
    flush()
    return [{k: v for k, v in x.items() if k != "captioned"} for x in items]


def sequences(pages: DataFrame, key: str | list[str] = "doc_id", html: str = "html") -> DataFrame:
    """key (one column or several), items of every page."""
    keys, kinds = [key] if isinstance(key, str) else key, dict(pages.dtypes)
    make = lambda: lambda b: {k: b[k] for k in keys} | {"items": list(map(parse, b[html]))}
    return map_batches(pages.select(*keys, html), make, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", items array<{ITEM}>")


def media_features(store: DataFrame) -> DataFrame:
    """digest and FEATURE of each row of store(digest, media), from the stored bytes read back."""

    def make():
        def f(b):
            out: dict = {"digest": b["digest"]} | {c.split()[0]: [] for c in FEATURE.split(", ")}
            for media in b["media"]:
                data = from_png(media)
                row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(data))
                for c, x in zip([*out][1:], row):
                    out[c].append(x)
            return out

        return f

    return map_batches(store.select("digest", "media"), make, f"digest string, {FEATURE}")


def resolve(sequence: DataFrame, features: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """One row an item, and one without position for a page without items: key, the item's fields, and of
    features(digest, ...), which has one row a digest, what its digest resolves to, else null. Only references take part in
    the join: texts have no digest and would all meet in one task."""
    keys = [key] if isinstance(key, str) else key
    items = sequence.select(*keys, F.explode_outer("items").alias("i")).select(*keys, "i.*")
    media = F.col("digest").isNotNull()
    found = items.where(media).join(features, "digest", "left")
    return found.unionByName(items.where(~media), allowMissingColumns=True)


def assemble(resolved: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """key, items: one array a document, in order of position; empty for a document without items."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in resolved.columns if c not in (*keys, "position")]
    items = F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", *rest)))
    return resolved.groupBy(*keys).agg(F.array_sort(items).alias("items"))


WHOLE, TAIL = "the whole text", "its last block"


def page_of(data: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """The page of a payload, and the (digest, payload) pairs of its pictures that have one."""
    digest, tail = hashlib.sha256(data).hexdigest(), hashlib.sha256(data[-WIDTH:]).hexdigest()
    turn = int(digest[:2], 16)
    whole = f'<figure><img src="{PREFIX}{digest}" alt="text"><figcaption>{WHOLE}</figcaption></figure>'
    last = f'<figure><figcaption>{TAIL}</figcaption><img src="{PREFIX}{tail}"></figure>'
    lost = f'<img src="{PREFIX}{hashlib.sha256(digest.encode()).hexdigest()}" alt="lost">'
    parts = [whole, f"<p>Between {lost} and after.</p>", last]
    if turn % 2:
        parts.reverse()
    return f"<article><h1>Document {digest[:8]}</h1>" + "<p>More text.</p>" * (turn % 5) + "<p>And so on.</p>".join(parts) + "</article>", [(digest, data), (tail, data[-WIDTH:])]


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, items, store (an array of digest, media): each document as the items that parse() finds in page_of()
    its text's payload, and the stored form of its pictures."""

    def make():
        def f(b):
            out: dict = {"doc_id": b["doc_id"], "n_bytes": [], "items": [], "store": []}
            for text in b["text"]:
                data, n = payload(text)
                html, pictures = page_of(data)
                out["n_bytes"].append(n)
                out["items"].append(parse(html))
                out["store"].append([{"digest": d, "media": to_png(p)} for d, p in dict(pictures).items()])
            return out

        return f

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, items array<{ITEM}>, store array<struct<digest:string,media:binary>>")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One written table, read by columns: pages here, the media store there. row tells repeated documents apart. Digests are
    # shuffled as bytes, half as long as their hexadecimal form.
    stored = documents_as_pages(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id())
    stored = materialise(stored, "media-store")
    known = media_features(stored.select(F.explode("store").alias("s")).select("s.*"))
    names, hashes = [c for c in known.columns if c != "digest"], ("payload_sha256", "media_sha256")
    known = known.select(F.unhex("digest").alias("digest"), *[F.unhex(c).alias(c) if c in hashes else F.col(c) for c in names])
    known = known.groupBy("digest").agg(*[F.first(c).alias(c) for c in names])  # copies of a text have equal features
    known = materialise(known, "media-features")
    keys = ["row", "doc_id", "n_bytes"]
    pages = stored.select(*keys, F.transform("items", lambda i: i.withField("digest", F.unhex(i["digest"]))).alias("items"))
    whole = F.filter("items", lambda i: i["caption"] == WHOLE)[0]
    count = lambda test: F.size(F.filter("items", test))
    documents = assemble(resolve(pages, known, keys), keys).select("*", whole.alias("w"))
    shown = [F.lower(F.hex(f"w.{c}")).alias(c) if c in hashes else F.col(f"w.{c}").alias(c) for c in names]
    return documents.select("doc_id", "n_bytes", *shown, F.col("w.position").alias("position"), F.col("w.caption").alias("caption"),
                            F.size("items").alias("n_items"), count(lambda i: i["kind"] == "media").alias("n_media"), count(lambda i: (i["kind"] == "media") & i["payload_bytes"].isNull()).alias("n_unresolved"))
