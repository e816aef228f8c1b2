import pytest
from pyspark.sql import functions as F

from quarry.operators import content as C

FILES = "user_id string, file_id long, http_status int, content binary"


def read(spark, files, ids=(11, 12)):
    req = spark.createDataFrame([("a", i, k) for k, i in enumerate(ids)], "user_id string, file_id long, pos int")
    return C.content_read(req, spark.createDataFrame(files, FILES))


def rows(df):
    return [(r.file_id, r.status, r.bytes_read, r.detail) for r in df.orderBy("pos").collect()]


def test_read_both(spark):
    body = b"%PDF-1.4 \x00\xff not json"
    got = read(spark, [("a", 11, 200, body), ("a", 12, 200, body)])
    assert rows(got) == [(11, "read", len(body), ""), (12, "read", len(body), "")]


@pytest.mark.parametrize("status", [404, 998])
def test_not_accessible(spark, status):
    got = read(spark, [("a", 11, status, b"x"), ("a", 12, status, b"x")])
    s = C.summary(got).first()
    assert (s.files, s.read, s.not_accessible, s.error, s.bytes) == (2, 0, 2, 0, 0)
    assert C.exit_code(got).first()[0] == 0


def test_error_keeps_the_run_going(spark):
    got = read(spark, [("a", 11, 500, b"x"), ("a", 12, 200, b"xyz")])
    assert rows(got) == [(11, "error", 0, "HTTPStatusError"), (12, "read", 3, "")]
    assert C.exit_code(got).first()[0] == 1
    assert [r[0] for r in got.orderBy("pos").select(C.report_line()).collect()] == ["file 11 error bytes=0 detail=HTTPStatusError", "file 12 read bytes=3"]


def test_redirects_count_as_read(spark):
    assert rows(read(spark, [("a", 11, 302, b"moved")], [11])) == [(11, "read", 5, "")]


def test_unknown_other_user_null_content_and_duplicates(spark):
    got = rows(read(spark, [("b", 11, 200, b"x"), ("a", 12, 200, None)], [11, 12, 12]))
    assert got == [(11, "not-accessible", 0, ""), (12, "read", 0, ""), (12, "read", 0, "")]


def test_no_requests(spark):
    got = read(spark, [("a", 11, 200, b"x")]).where("false")
    assert list(C.summary(got).first()) == [0, 0, 0, 0, 0]
    assert C.exit_code(got).first()[0] == 0
    assert {r.status: r.n for r in C.status_counts(got).collect()} == {"read": 0, "not-accessible": 0, "error": 0}
    assert C.summary_line(C.summary(got)).first()[0] == "summary files=0 read=0 not-accessible=0 error=0 bytes=0"


def test_blocks(spark):
    df = spark.createDataFrame([(1, bytes(2 * 65_536 + 17)), (2, b""), (3, None), (4, b"x" * 65_536)], "file_id long, content binary")
    got = [(r.file_id, r.block_no, r.block_bytes, r.running_bytes, len(r.block)) for r in C.content_blocks(df).orderBy("file_id", "block_no").collect()]
    assert got == [(1, 0, 65536, 65536, 65536), (1, 1, 65536, 131072, 65536), (1, 2, 17, 131089, 17), (4, 0, 65536, 65536, 65536)]


def test_gateway_precedence(spark):
    req = spark.createDataFrame([(1, "x", "u", 1), (2, "b", "u", 9), (3, "b", "v", 1), (4, "b", "u", 2), (5, "b", "u", 3), (6, "b", "u", 4), (7, "b", "u", 1), (8, None, "u", 1)], "n int, caller string, user_id string, file_id long")
    nodes = spark.createDataFrame([("u", 1, True, True, False), ("u", 2, False, True, False), ("u", 3, True, False, True), ("u", 4, True, True, True)], "user_id string, file_id long, is_file boolean, opens boolean, fails boolean")
    got = {r.n: r.code for r in C.gateway_verdict(req, nodes, "b").collect()}
    assert got == {1: 403, 2: 404, 3: 404, 4: 404, 5: 422, 6: 500, 7: 200, 8: 403}


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").where(F.col("source") == "src1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan
