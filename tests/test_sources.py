import io
import zipfile

from pyspark.sql import functions as F

from quarry.operators import manifest, rules, search, status
from quarry.sources import files, ids, sinks
from quarry.streaming import requests as stream


def test_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", "11 not-a-number 13"), ("b", "11 0 13"), ("c", "-5"), ("d", "7 7\n8")], "name string, content string")
    p = ids.parse(df)
    assert {r.name: r.entry for r in ids.first_errors(p).collect()} == {"a": 2, "b": 2, "c": 1}
    assert [r.file_id for r in p.where("name = 'd'").orderBy("pos").collect()] == [7, 7, 8]
    (tmp_path / "ids.txt").write_text("3 1 3")
    u = ids.union(spark.createDataFrame([(0, -2)], "pos int, file_id long"), ids.read(spark, str(tmp_path)))
    assert [r.file_id for r in u.orderBy("part", "pos").collect()] == [-2, 3, 1, 3]


CASES = [
    ("views.py", "import nc_py_api", [1]), ("client.py", "import nc_py_api", []), ("views.py", "from httpx import get", [1]), ("client.py", "import httpx", []), ("client.py", "nc.set_user('x')", [2]), ("views.py", "nc.ocs('PUT', '/x')", [3]),
    ("views.py", "nc.ocs(verb, path)", [3]), ("views.py", "index.request(verb, path)", []), ("views.py", "nc.ocs('GET', '/x')", []), ("views.py", "nc._session.delete(url='/y')", [2, 3]), ("views.py", "writer.post('/x')", []), ("views.py", "def upload(): pass", [2]), ("views.py", "nc.client().request(method='post', path='/z')", [3]), ("views.py", "not python (", []), ("views.py", "x = " + "1+" * 50_000 + "1", []), ("views.py", "nc.a(writer).put(path=p, url='/q')", [3]),
]


def test_rules_from_source(spark):
    df = spark.createDataFrame([(f"{k}/{p}", s) for k, (p, s, _) in enumerate(CASES)], "path string, source string")
    found = rules.violations(files.python_nodes(df)).collect()
    got = {k: sorted(r.invariant for r in found if r.path.startswith(f"{k}/")) for k in range(len(CASES))}
    assert got == {k: w for k, (_, _, w) in enumerate(CASES)}
    assert "12/views.py:1: invariant 3, POST on /z" in [r.message for r in found]


def test_own_package_is_clean(spark):
    import quarry

    tree = files.source_tree(spark, quarry.__path__[0])
    assert rules.as_list(rules.violations(files.python_nodes(tree)).where("invariant = 1")).count() == 0


def test_manifest_of_files(spark, tmp_path):
    sinks.write_corpus({"a.txt": b"one", "empty.pdf": b"", "b.bin": bytes(range(256))}, str(tmp_path / "c"))
    m = manifest.manifest(files.binary_files(spark, str(tmp_path / "c")))
    assert {r.name: r.bytes for r in m.collect()} == {"a.txt": 3, "empty.pdf": 0, "b.bin": 256}
    assert manifest.total(m).first().bytes == 259
    assert manifest.unchanged(m, m).first().unchanged is True
    other = m.withColumn("mtime", F.col("mtime") + F.when(F.col("name") == "a.txt", 1).otherwise(0)).where("name <> 'b.bin'")
    assert {r.name: r.change for r in manifest.diff(m, other).collect()} == {"a.txt": "changed", "b.bin": "removed", "empty.pdf": "same"}


def test_docx(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>Gr&#252;n &amp; </w:t></w:r><w:r><w:t xml:space="preserve"> blau</w:t></w:r></w:p><w:p w:x="1"><w:t>zwei</w:t></w:p></w:document>')
    df = spark.createDataFrame([("a", data.getvalue()), ("b", b"no zip"), ("c", None)], "name string, content binary")
    assert [(r.name, r.status, r.text) for r in files.docx_text(df).orderBy("name").collect()] == [("a", "read", "Grün &  blau\nzwei"), ("b", "skipped", None), ("c", "skipped", None)]


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 12, "error", 0, "E"), (0, 11, "read", 3, "")], "pos int, file_id long, status string, bytes_read long, detail string")
    sinks.report(df, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(lines) == ["file 11 read bytes=3", "file 12 error bytes=0 detail=E", "summary files=2 read=1 not-accessible=0 error=1 bytes=3"]
    sinks.discard(df)


def test_search(spark):
    df = spark.createDataFrame([(1, "The cat, the hat."), (2, "A dog"), (3, None), (4, "the THE the")], "doc_id long, text string")
    assert {(r.term, r.doc_id): r.tf for r in search.postings(df).collect()}[("the", 4)] == 3
    assert [r.doc_id for r in search.search(df, ["the"]).collect()] == [4, 1]
    assert [(r.doc_id, r.start, r.end) for r in search.highlights(df, "the").orderBy("doc_id", "start").collect()] == [(1, 0, 3), (1, 9, 12), (4, 0, 3), (4, 4, 7), (4, 8, 11)]
    dots = spark.createDataFrame([(1, "a.b.c")], "doc_id long, text string")
    assert [(r.start, r.end) for r in search.highlights(dots, ".").orderBy("start").collect()] == [(1, 2), (3, 4)]


def test_stream(spark, tmp_path):
    at = str(tmp_path / "log")
    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:01:00' AS ts, '{\"query\": \"a\"}' AS body, 'u' AS user UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 00:02:00', '{}', 'u' UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 01:00:00', '{}', 'u'").coalesce(1).write.parquet(at)
    counts = stream.verdict_counts(stream.read_log(spark, at, spark.read.parquet(at).schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.code, r.n) for r in spark.table("verdicts").collect()) == [(200, 1), (422, 1), (422, 1)]


def test_status(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert status.by_hour(e).agg(F.sum("n")).first()[0] == e.count()


def test_docx_of_other_writers(spark):
    import io
    import zipfile

    body = ('<w:p w:rsidR="1"><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t xml:space="preserve"> b </w:t></w:r></w:p><w:p/><w:p w:x="2"/>'
            '<w:p><w:pPr/><w:r><w:t>c &lt;d&gt;</w:t><w:br w:type="page"/><w:t>e</w:t><w:cr/></w:r><w:proofErr w:type="x"/><w:r><w:t/></w:r></w:p>')
    assert files.paragraphs(body) == ["a\t b ", "", "", "c <d>\ne\n"]
    assert files.paragraphs("<w:p>" * 200_000 + "<w:t " * 200_000) == []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", body * 3)
    whole = out.getvalue()
    rows = [("whole", whole)] + [(f"{k}-{x}", whole[:k] + bytes([whole[k] ^ x]) + whole[k + 1 :]) for k in range(len(whole)) for x in (1, 64, 255)] + [(f"cut {k}", whole[:k]) for k in range(0, len(whole), 7)]
    got = {r.name: (r.status, r.text) for r in files.docx_text(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert len(got) == len(rows) and got["whole"] == ("read", "\n".join(["a\t b ", "", "", "c <d>\ne\n"] * 3))
    assert {t for s, t in got.values() if s == "skipped"} == {None} and sum(s == "skipped" for s, _ in got.values()) > 100


def test_files_cross_to_python_by_bytes_and_one_at_a_time(spark):
    """Long texts in one partition: no batch holds more than a few of them, going in or coming out."""
    import pyarrow as pa

    text = "x" * 2**20
    df = spark.range(0, 40, 1, 1).selectExpr("cast(id as string) AS name", f"repeat('x', {2**20}) AS content", "false AS broken")
    made = files.as_docx(df)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    for d in (df, made, files.docx_text(made)):
        assert max(r.n for r in d.mapInArrow(sizes, "n long").collect()) < 8 << 20
    assert {r.text == text for r in files.docx_text(made).collect()} == {True}
