import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import hits as H


def shaped(spark, *elements):
    df = spark.createDataFrame([(k, e) for k, e in enumerate(elements)], "pos int, j string").select("pos", F.try_parse_json("j").alias("element"))
    return H.shaped(df)


@pytest.mark.parametrize("value", ['"5"', "5.0", "true", "12345678901234567890", "null", "[5]"])
def test_only_integers_are_ids(spark, value):
    assert shaped(spark, '{"fileId": %s, "title": "t", "snippet": "s"}' % value).first().verdict == "dropped"


def test_one_bad_element_costs_itself(spark):
    got = shaped(spark, '{"fileId": 5, "title": "t", "snippet": "s"}', '{"fileId": 5, "title": 1, "snippet": "s"}', "7", None)
    assert [r.verdict for r in got.orderBy("pos").collect()] == ["ok", "dropped", "dropped", "dropped"]


def test_sentinel_needs_its_exact_title(spark):
    s = H.SENTINEL
    got = shaped(spark, '{"fileId": 0, "title": "%s", "snippet": "a\\nb"}' % s, '{"fileId": -4, "title": "%s", "snippet": "x"}' % s, '{"fileId": 0, "title": "%s!", "snippet": "x"}' % s)
    assert [(r.verdict, r.file_id, r.snippet) for r in got.orderBy("pos").collect()][:2] == [("sentinel", 0, "ab"), ("sentinel", 0, "x")]
    assert got.where("pos = 2").first().verdict == "dropped"


def test_cleaning(spark):
    row = spark.createDataFrame([("a\x00b\x07c\nd\te" + chr(0x202E) + "f" + chr(0x2028) + "g",)], "s string").select(X.plain_text("s", 1000)).first()
    assert row[0] == "abcd\tefg"
    long = spark.createDataFrame([("😀" * 1001,)], "s string").select(X.plain_text("s", 1000), X.plain_text("s", 255)).first()
    assert (len(long[0]), len(long[1])) == (1000, 255)
    bad = spark.createDataFrame([(b"a\xff",)], "s binary").select(X.plain_text(F.col("s").cast("string"), 10)).first()
    assert bad[0] is None


HITS = "user_id string, answer_id int, pos int, file_id long, title string, snippet string, verdict string"
NODES = "user_id string, file_id long, name string, path string"


def recheck(spark, rows, folders=("u",)):
    nodes = spark.createDataFrame([("u", 5, "na\nme", "//a/b"), ("u", 6, "n" * 300, None)], NODES)
    f = spark.createDataFrame([(x,) for x in folders], "user_id string")
    return [(r.outcome, r.file_id, r.path, r.title) for r in H.recheck(spark.createDataFrame(rows, HITS), nodes, f).orderBy("pos").collect()]


def test_recheck(spark):
    rows = [("u", 1, 0, 5, "t", "s", "ok"), ("u", 1, 1, 7, "t", "s", "ok"), ("u", 1, 2, 0, H.SENTINEL, "s", "sentinel"), ("u", 1, 3, 6, "t", "s", "ok"), ("u", 1, 4, None, None, None, "dropped"), ("u", 1, 5, 5, "t", "s", "ok")]
    got = recheck(spark, rows)
    assert [g[0] for g in got] == ["kept", "unresolved", "kept", "kept", "dropped", "kept"]
    assert got[0][2:] == ("a/b", "name") and got[2][1:] == (0, "", H.SENTINEL) and got[3][2] == "" and len(got[3][3]) == 255
    counts = H.drop_counts(spark.createDataFrame([(g[0],) for g in got], "outcome string")).first()
    assert (counts.dropped, counts.unresolved, counts.kept) == (1, 1, 4)


def test_no_folder_loses_the_answer_but_not_a_lone_sentinel(spark):
    with_id = [("u", 1, 0, 0, H.SENTINEL, "s", "sentinel"), ("u", 1, 1, 5, "t", "s", "ok")]
    assert [g[0] for g in recheck(spark, with_id, ())] == ["lost", "lost"]
    assert [g[0] for g in recheck(spark, with_id[:1], ())] == ["kept"]


def test_invalid_node_name_is_dropped_not_unresolved(spark):
    nodes = spark.createDataFrame([("u", 5, b"\xff", "/x")], "user_id string, file_id long, name binary, path string").withColumn("name", F.col("name").cast("string"))
    hits = spark.createDataFrame([("u", 1, 0, 5, "t", "s", "ok")], HITS)
    assert H.recheck(hits, nodes, spark.createDataFrame([("u",)], "user_id string")).first().outcome == "dropped"
    assert H.permission_filter(hits, nodes).count() == 0


def test_body_limit_is_bytes(spark):
    head, tail = '{"results": ["', '"]}'
    room = H.MAX_BODY - len(head) - len(tail)
    rows = [("response", 200, head + "x" * room + tail), ("response", 200, head + "x" * (room + 1) + tail), ("response", 200, head + "é" * (room // 2 + 1) + tail)]
    got = H.triage(spark.createDataFrame(rows, "kind string, status int, body string"))
    assert sorted(r.verdict for r in got.select("verdict").collect()) == ["ok", "too large", "too large"]


def test_entries_and_envelope(spark):
    df = spark.createDataFrame([(1, 5, "p", "t", "s"), (0, 0, "", "u", "v")], "pos int, file_id long, path string, title string, snippet string")
    e = H.entries(df).orderBy("pos").collect()
    assert [(r.url, r.subline, r.thumbnail) for r in e] == [("/files", "v", ""), ("/f/5", "s", "")]
    assert H.envelope(df).first().body == '{"results":[{"fileId":0,"path":"","title":"u","snippet":"v"},{"fileId":5,"path":"p","title":"t","snippet":"s"}]}'
    assert H.envelope(df.where("false")).first().body == '{"results":[]}'


def test_markup(spark):
    df = spark.createDataFrame([("plain",), ("<b>x",)], "snippet string")
    assert [r[0] for r in df.select(H.without_markup()).collect()] == [True, False]
