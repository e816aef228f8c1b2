import hashlib
import http.server
import json
import os
import tempfile
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import content
from quarry.sources import content_source as S
from quarry.sources import corpus_sink as C

BIG = bytes(range(256)) * 1000


class Stub(http.server.BaseHTTPRequestHandler):
    """Answers by id: 4xx and 5xx ids their own code, 302 a redirect, 7 slowly, 8 less than promised, 9 a large body."""

    protocol_version = "HTTP/1.1"

    def do_GET(self):
        i = int(self.path.rsplit("/", 1)[1])
        body = BIG if i == 9 else f"{self.headers['X-User-Id']}:{i}".encode()
        self.send_response(i if 300 <= i < 1000 else 200)
        if i == 302:
            self.send_header("Location", "/content/1")
        self.send_header("Content-Length", str(len(body) + 5 * (i == 8)))
        self.end_headers()
        if i == 7:
            for b in body:
                time.sleep(0.6)
                try:
                    self.wfile.write(bytes([b]))
                    self.wfile.flush()
                except OSError:
                    return
            return
        self.wfile.write(body)
        if i == 8:
            self.close_connection = True

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/index"
    server.shutdown()


def read(spark, url, **options):
    spark.dataSource.register(S.ContentSource)
    return spark.read.format("content").options(base=url, user="u1", timeout="2", **options).load()


def test_answers(spark, url):
    rows = {r.file_id: r for r in read(spark, url, ids="1-3, 7 8 9 302 404 500 998", batch="2").collect()}
    assert len(rows) == 10 and all(r.user_id == "u1" for r in rows.values())
    for i in (1, 2, 3, 302):
        body = f"u1:{i}".encode()
        assert (rows[i].n_bytes, rows[i].sha256, rows[i].failure) == (len(body), hashlib.sha256(body).hexdigest(), None)
    assert rows[9].n_bytes == len(BIG) and rows[9].sha256 == hashlib.sha256(BIG).hexdigest()
    assert [rows[i].http_status for i in (302, 404, 500, 998)] == [302, 404, 500, 998]
    assert rows[7].failure == "TimeoutError" and rows[8].failure == "IncompleteRead" and rows[7].sha256 is None
    wanted = spark.createDataFrame([("u1", i) for i in (1, 7, 9, 302, 404, 500, 998, 5)], "user_id string, file_id long")
    got = {r.file_id: (r.status, r.bytes_read, r.detail) for r in content.content_read(wanted, read(spark, url, ids="1 7 9 302 404 500 998")).collect()}
    assert got == {1: ("read", 4, ""), 7: ("error", 0, "TimeoutError"), 9: ("read", 256_000, ""), 302: ("read", 6, ""), 404: ("not-accessible", 0, ""),
                   500: ("error", 0, "HTTPStatusError"), 998: ("not-accessible", 0, ""), 5: ("not-accessible", 0, "")}


def test_blocks_limits_and_lost_servers(spark, url):
    rows = sorted(read(spark, url, ids="9 404 1", blocks="true").collect(), key=lambda r: (r.file_id, r.block_no))
    assert b"".join(bytes(r.block) for r in rows if r.file_id == 9) == BIG and {r.file_id for r in rows} == {1, 9}
    assert all(len(r.block) <= 65_536 for r in rows) and rows[-1].running_bytes == len(BIG)
    assert read(spark, url, ids="9", most="1000").first().failure == "OverflowError"
    assert read(spark, "http://127.0.0.1:9/", ids="1").first().failure == "ConnectionRefusedError"
    assert read(spark, url, ids="").count() == 0


def test_ids_from_a_table(spark, url):
    at = os.path.join(tempfile.gettempdir(), f"quarry-ids-{uuid.uuid4().hex}")
    S.write_ids(spark.range(20, 50).withColumnRenamed("id", "file_id").repartition(3), at)
    df = read(spark, url, ids_from=at)
    assert df.rdd.getNumPartitions() == 3 and sorted(r.file_id for r in df.collect()) == list(range(20, 50))
    with pytest.raises(ValueError):
        S.parse_ids("4 x")


def folder():
    return os.path.join(tempfile.gettempdir(), f"quarry-corpus-{uuid.uuid4().hex}")


def below(at):
    return {os.path.relpath(os.path.join(d, f), at): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(at) for f in fs}


def test_manifest_equals_the_files(spark):
    rows = [(f"a/b{k}.txt" if k % 3 else f"é {k}", (f"text {k}" * k).encode() if k else None) for k in range(40)]
    at = C.write(spark.createDataFrame(rows, "name string, content binary").repartition(5), folder())
    files = below(at)
    listed = {r.path: (r.bytes, r.sha256) for r in C.manifest(spark, at).collect()}
    data = {p: b for p, b in files.items() if p.startswith("part-")}
    assert listed == {p: (len(b), hashlib.sha256(b).hexdigest()) for p, b in data.items()} and len(listed) == 40
    assert sorted(p.split("/", 1)[1] for p in data) == sorted(n for n, _ in rows)
    assert json.loads(files["_TOTAL"]) == {"files": 40, "bytes": sum(map(len, data.values()))} and not any("_staging" in p for p in files)
    with pytest.raises(FileExistsError):
        C.write(spark.createDataFrame(rows, "name string, content binary"), at)


def test_a_failed_task_leaves_nothing_behind(spark):
    at = folder()
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception):
        C.write(df, at)
    assert below(at) == {}
    with pytest.raises(FileNotFoundError):
        C.manifest(spark, at)
    for name in ("../x", "/x", "a//b", "", None):
        with pytest.raises(Exception):
            C.write(spark.createDataFrame([(name, b"x")], "name string, content binary"), at)
    assert below(at) == {}


def test_an_empty_corpus(spark):
    at = C.write(spark.createDataFrame([], "name string, content binary"), folder())
    assert C.manifest(spark, at).count() == 0 and json.loads(below(at)["_TOTAL"]) == {"files": 0, "bytes": 0}
