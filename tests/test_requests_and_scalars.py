import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import requests as R
from quarry.sources import config


@pytest.mark.parametrize(
    "body, user, code",
    [('{"query":"contract"}', "alice", 200), ('{"query":"contract","userId":"bob"}', "alice", 400), ('{"query":"contract","limitt":5}', "alice", 422), ('{"query":"contract","limit":0}', "alice", 422), ('{"query":"contract","limit":101}', "alice", 422),
     ('{"query":"contract"}', "", 401), ('{"query":"contract"}', None, 401), ('{"limit":0,"uid":1}', None, 400), ('{"query":" "}', "a", 200), ("", "a", 422), (None, "a", 422), ('{"query":"a","limit":100}', "a", 200), ('{"query":"a","limit":3.0}', "a", 200), ('{"query":"a","limit":3.5}', "a", 422)],
)
def test_validation(spark, body, user, code):
    got = R.validated(spark.createDataFrame([(body, user)], "body string, user string")).first()
    assert got.code == code
    assert (got.limit is not None) == (code == 200)


def test_default_limit(spark):
    got = R.validated(spark.createDataFrame([('{"query":"contract"}', "alice")], "body string, user string")).first()
    assert (got.query, got.limit) == ("contract", 20)


def test_admission(spark):
    rows = [("a", " \0\x0b", 5), ("a", "\tx y\n", 500), ("b", "x", 5), ("c", "x", -1)]
    users, enabled = (spark.createDataFrame([(u,) for u in us], "user_id string") for us in ("ab", "ac"))
    got = R.admitted(spark.createDataFrame(rows, "user_id string, term string, limit int"), users, enabled).collect()
    assert [(r.user_id, r.term, r.limit) for r in got] == [("a", "x y", 100)]


@pytest.mark.parametrize("url, base", [("https://h/", "https://h"), ("https://h/index.php/", "https://h"), ("https://h//", "https://h"), ("https://h/index.php//", "https://h/index.php"), (None, ""), ("https://h/index.phpx", "https://h/index.phpx")])
def test_base_url(spark, url, base):
    want = url
    if url is None:
        want = ""
    for end in ("/", "/index.php", "/"):
        want = want.removesuffix(end)
    got = spark.createDataFrame([(url,)], "u string").select(X.base_url("u")).first()[0]
    assert got == want
    assert url == "https://h/index.php//" or got == base


def test_credential_is_one_line(spark):
    got = spark.createDataFrame([("u" * 100, "s" * 100)], "u string, s string").select(X.credential("u", "s")).first()[0]
    assert "\n" not in got and "\r" not in got and len(got) == 268


def test_settings(spark):
    rows = [(None, None), ("12", "0"), (" 1_0 ", "TRUE"), ("1d", "/p"), ("nope", "False"), ("", "x"), ("inf", "1")]
    df = spark.createDataFrame(rows, "t string, c string").select(X.timeout_seconds("t"), X.tls_setting("c")).collect()
    assert [r[0] for r in df] == [90.0, 12.0, 10.0, None, None, None, math.inf]
    assert [r[1] for r in df] == ["true", "false", "true", "/p", "false", "x", "true"]


def test_environment(spark, monkeypatch):
    monkeypatch.setenv("A_PORT", "80")
    got = config.normalised(config.from_environment(spark, {"port": "A_PORT"})).first()
    assert (got.log_level, got.problem, got.binding, got.tls, got.timeout) == ("info", None, "tcp 127.0.0.1:80", "true", 90.0)


def test_detected_text(spark):
    df = spark.createDataFrame([("Grüße €".encode(),), ("Grüße € „x“".encode("cp1252"),), (b"",), (None,)], "c binary")
    assert [r[0] for r in df.select(X.detected_text("c")).collect()] == ["Grüße €", "Grüße € „x“", "", None]


def test_route_and_identity(spark):
    df = spark.createDataFrame([("files.view", ""), ("files", "u"), (None, None)], "r string, u string")
    assert [tuple(r) for r in df.select(X.provider_order("r"), X.identity("u")).collect()] == [(-5, None), (25, "u"), (25, None)]


def test_epoch_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:01.9' AS t").select(X.epoch_seconds("t"), X.iso_seconds("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == (1710037801, "2024-03-10T02:30:01+00:00")


def test_unsafe_class_matches_unicode(spark):
    import unicodedata

    df = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    got = {r.id for r in df.where(F.col("c").rlike(X.UNSAFE)).select("id").collect()}
    want = {i for i in range(1, 0x110000) if unicodedata.category(chr(i)) in ("Cc", "Cf", "Zl", "Zp") and i != 9}
    assert got == want - {0xFEFF}  # the decoder takes this one for a byte order mark
    assert spark.createDataFrame([(chr(0xFEFF),)], "s string").select(X.plain_text("s", 9)).first()[0] == ""
