import hashlib

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.functions.text import detected_text
from quarry.operators import manifest
from quarry.sources import files, sinks


def test_files_easy_and_hard(spark, tmp_path):
    docx = files.as_docx(spark.createDataFrame([("x", "Brief\nÜber <uns> & mehr", False)], "name string, content string, broken boolean")).first().content
    made = {"a/letter.docx": bytes(docx), "b/letter.docx": b"", "plain.txt": "Straße\n".encode(), "old.txt": "Maß – 7 €".encode("cp1252"), "noise.bin": bytes(range(256)), "b/_hidden": b""}
    sinks.write_corpus(made, str(tmp_path))
    read = files.binary_files(spark, str(tmp_path))
    m = {r.name: (r.bytes, r.sha256) for r in manifest.manifest(read).collect()}
    assert m == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in made.items() if n != "b/_hidden"}
    assert {r.name for r in files.binary_files(spark, str(tmp_path), "*.docx").collect()} == {"a/letter.docx", "b/letter.docx"}
    docs = {r.name: (r.status, r.text) for r in files.docx_text(read).collect()}
    assert docs["a/letter.docx"] == ("read", "Brief\nÜber <uns> & mehr") and sum(s == "read" for s, _ in docs.values()) == 1
    texts = {r.name: r.t for r in read.where(F.col("name").endswith(".txt")).select("name", detected_text("content").alias("t")).collect()}
    assert texts == {"plain.txt": "Straße\n", "old.txt": "Maß – 7 €"}


def test_cli(spark, sf, tmp_path, capsys):
    own = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").where("source = 'src1'")
    good = own.where("toxic IS NULL").first().doc_id
    assert cli.main(["--user-id", "src1", "--tables", sf, str(good), "999999999"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith(f"file {good} read bytes=") and lines[1] == "file 999999999 not-accessible bytes=0" and lines[2].startswith("summary files=2 read=1 not-accessible=1 error=0")
    bad = tmp_path / "ids"
    bad.write_text("1 x 3")
    for args in (["--ids-file", str(bad)], ["--ids-file", str(tmp_path / "none")], [], ["x"]):
        with pytest.raises(SystemExit) as e:
            cli.main(["--user-id", "src1", "--tables", sf, *args], spark)
        assert e.value.code == 2
    assert "entry 2" in capsys.readouterr().err
    toxic = own.where("toxic = 1").first()
    if toxic:
        assert cli.main(["--user-id", "src1", "--tables", sf, str(toxic.doc_id)], spark) == 1
