import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import media as M


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_round_trip(text):
    data, n = M.payload(text)
    assert len(data) % 64 == 0 and data and data[:n] == text.encode("utf-8", "surrogatepass") and not any(data[n:])
    assert M.from_png(M.to_png(data)) == data


def test_damage_is_noticed():
    png = bytearray(M.to_png(M.payload("hello")[0]))
    png[45] ^= 1
    with pytest.raises(ValueError):
        M.from_png(bytes(png))
    with pytest.raises(ValueError):
        M.from_png(b"GIF89a")


def test_parse_keeps_order_and_captions():
    html = "<h1>A &amp; b</h1><figure><figcaption>one <b>two</b></figcaption><img src='sha256:AB'></figure><p>x <img src=\"sha256:cd\" alt='al'> y<script>'<p>'</script><figure><img src='sha256:ef' alt='no'><figcaption>late</figcaption></figure><img src='http://z'>end"
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in M.parse(html)] == [
        (0, "text", "A & b", None, None), (1, "media", None, "ab", "one two"), (2, "text", "x", None, None), (3, "media", None, "cd", "al"), (4, "text", "y", None, None), (5, "media", None, "ef", "late"), (6, "text", "end", None, None)]
    assert M.parse(None) == [] and M.parse("") == []


def test_unclosed_and_several_captions():
    items = lambda h: [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in M.parse(h)]
    assert items("<figure><img src='sha256:a'><figcaption>one<p>two</figure><p>after</p>") == [("media", "a", "one two"), ("text", "after", None)]
    assert items("<p>x<figure><img src='sha256:a' alt='no'><figcaption>cap <b>tion") == [("text", "x", None), ("media", "a", "cap tion")]
    assert items("<figure><figcaption>1<img src='sha256:a'><figcaption>2</figcaption><img src='sha256:b'><figcaption>3</figcaption></figure>") == [("media", "a", "1"), ("media", "b", "2")]
    assert items("<figure><img src='sha256:a'><img src='sha256:b'><figcaption>both</figcaption></figure><img src='sha256:c' alt='own'>") == [("media", "a", "both"), ("media", "b", "both"), ("media", "c", "own")]


def test_broken_markup():
    items = lambda h: [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in M.parse(h)]
    assert items("<p>x</p><img alt=\"x src='sha256:aa'><p>after</p><p>b</p>") == [("text", "x", None), ("text", "after", None), ("text", "b", None)] or items("<img alt=\"x src='sha256:aa'><p>after</p>")[-1] == ("text", "after", None)
    assert items("<p>x</p><!-- <img src='sha256:a'> never closed") == [("text", "x", None)]
    assert items('<img src="sha256:A" data-x=it\'s alt=al>y') == [("media", "a", "al"), ("text", "y", None)]
    assert items("<figure><figure><img src=sha256:b></figure><figcaption>in<figcaption>out</figcaption></figure>z")[-1] == ("text", "z", None)
    assert items("<head><title>t</title><body>x<script>'<p>'</script>y") == [("text", "x", None), ("text", "y", None)]
    assert items("a < b <img src='sha256:c'") == [("text", "a < b", None), ("media", "c", None)]

    import time

    begun = time.process_time()
    M.parse("<p a='x " * 14_000)
    assert time.process_time() - begun < 5


def test_resolve_and_assemble(spark):
    data = M.payload("picture")[0]
    store = spark.createDataFrame([("aa", M.to_png(data))], "digest string, media binary")
    pages = spark.createDataFrame([(1, "<p>t<img src='sha256:aa' alt='c'>u"), (2, "<img src='sha256:bb'>"), (3, None)], "doc_id long, html string")
    got = M.assemble(M.resolve(M.sequences(pages), M.media_features(store)))
    rows = {r.doc_id: r["items"] for r in got.collect()}
    assert [i.position for i in rows[1]] == [0, 1, 2] and rows[1][1].caption == "c" and rows[1][1].payload_sha256 == hashlib.sha256(data).hexdigest()
    assert rows[2][0].payload_bytes is None and rows[3] == [] and set(rows) == {1, 2, 3}


def test_query_against_plain(spark, tmp_path):
    texts = [(1, "a" * 64), (2, "é" * 33), (3, ""), (4, None), (5, "a" * 64), (6, "long " * 40000), (7, "\x00\n<p>"), (7, "\x00\n<p>"), (None, "x")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    all_ = M.op3_media(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in all_}
    for i, t in texts:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        turn = hashlib.sha256(data).digest()[0]
        assert (r.n_items, r.n_media, r.n_unresolved, r.caption) == (1 + turn % 5 + 3 + 2 + 2, 3, 1, M.WHOLE)
        assert r.position == (1 + turn % 5 if turn % 2 == 0 else r.n_items - 1)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[1][2:8] == got[5][2:8] and got[3].feature == got[4].feature and len(all_) == len(texts)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert M.op3_media(spark, str(tmp_path)).count() == 0
