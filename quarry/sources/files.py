"""Files by content, source trees as syntax nodes, and text of office documents."""

from __future__ import annotations

import ast
import fnmatch
import io
import lzma
import re
import struct
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import BATCH_BYTES, BATCH_ROWS, small_batches


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, content, mtime of every file below path whose last part matches pattern; name is the path below `path`. Spark's
    file index leaves out empty files, so these are listed apart, the folders at the top side by side."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(at).toString().rstrip("/")

    def empty_below(entry) -> list[tuple]:
        todo, found = [entry], []
        while todo:
            f = todo.pop()
            last = f.getPath().getName()
            if last.startswith(("_", ".")):
                continue
            if f.isDirectory():
                todo += fs.listStatus(f.getPath())
            elif f.getLen() == 0 and fnmatch.fnmatchcase(last, pattern):
                found.append((f.getPath().toString()[len(root) + 1 :], b"", f.getModificationTime() // 1000))
        return found

    with ThreadPoolExecutor(16) as pool:
        empty = [row for rows in pool.map(empty_below, fs.listStatus(at)) for row in rows]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    read = read.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "content", F.unix_timestamp("modificationTime").alias("mtime"))
    return read.unionAll(spark.createDataFrame(empty, "name string, content binary, mtime long")) if empty else read


NODES = "path string, line int, kind string, name string, receiver string, positional array<string>, named map<string,string>"


def syntax_rows(path: str, source: str) -> list[tuple]:
    """What a module imports, every name that it mentions or defines, and its calls of attributes: with the dotted path of
    the receiver, and the arguments that are literal strings (others are null), by position and by keyword."""
    order = [ast.parse(source)]
    for node in order:  # grows while it is read: parents stand before their children
        order.extend(ast.iter_child_nodes(node))
    dotted: dict = {}
    for node in reversed(order):
        if isinstance(node, ast.Name):
            dotted[node] = node.id
        elif isinstance(node, ast.Attribute):
            dotted[node] = f"{dotted.get(node.value, '')}.{node.attr}"
        elif isinstance(node, ast.Call):
            dotted[node] = dotted.get(node.func, "")
    text = lambda e: e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None
    rows: list[tuple] = []
    for node in order:
        match node:
            case ast.Import(names=names):
                rows += [(path, node.lineno, "import", n.name, None, None, None) for n in names]
            case ast.ImportFrom(module=str(module)):
                rows.append((path, node.lineno, "import", module, None, None, None))
            case ast.Name(id=name) | ast.Attribute(attr=name) | ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
                rows.append((path, node.lineno, "identifier", name, None, None, None))
            case ast.Call(func=ast.Attribute(value=value, attr=name)):
                named = {k.arg: text(k.value) for k in node.keywords if k.arg}
                rows.append((path, node.lineno, "call", name, dotted.get(value, ""), list(map(text, node.args)), named))
    return rows


def python_nodes(sources: DataFrame) -> DataFrame:
    """The node table of sources(path, source), for quarry.operators.rules. A file that can't be read as Python, be it for
    its depth, gives one node of kind 'unreadable'."""
    import pandas as pd

    columns = [c.split()[0] for c in NODES.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"]):
                try:
                    rows += syntax_rows(path, source or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((path, 0, "unreadable", None, None, None, None))
            yield pd.DataFrame(rows, columns=columns)

    small_batches(sources.sparkSession)
    return sources.select("path", "source").mapInPandas(run, NODES)


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, source of the Python files below path."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))


#: The main part of a document may unpack to so many bytes; what is larger is skipped.
MOST_XML = 256 * 2**20
_WORD = re.compile(r"<w:t(?: [^<>]*)?>(?P<text>[^<]*)</w:t>|<(?P<tag>/?w:(?:tab|br|cr|pPr|p))(?: [^<>]*?)?(?P<closed>/?)>")


def paragraphs(xml: str) -> list[str]:
    """The paragraphs of a word-processor document's main part, empty ones included, with its tabs and breaks. One pass; the
    tab stops that a paragraph's properties name are no text."""
    from html import unescape

    out, now, properties = [], [], False
    for m in _WORD.finditer(xml):
        tag, closed = m["tag"], m["closed"]
        if tag is None:
            now.append(unescape(m["text"]))
        elif tag in ("w:pPr", "/w:pPr"):
            properties = tag == "w:pPr" and not closed
        elif tag == "/w:p" or tag == "w:p" and closed:
            out.append("".join(now))
            now, properties = [], False
        elif tag != "w:p" and not properties:
            now.append("\t" if tag == "w:tab" else "\n")
    return out


def each_row(df: DataFrame, work, schema: str) -> DataFrame:
    """work(*values) of each row of df, as rows of schema. Rows are whole files: one is held at a time, and results are handed on
    when there are BATCH_BYTES of them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    kind, rows_, bytes_ = to_arrow_schema(StructType.fromDDL(schema)), BATCH_ROWS, BATCH_BYTES

    def run(batches):
        out, size = [], 0
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
        for b in batches:
            for i in range(b.num_rows):
                row = work(*(c[i].as_py() for c in b.columns))
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if len(out) >= rows_ or size >= bytes_:
                    yield pack(out)
                    out, size = [], 0
        if out:
            yield pack(out)

    return df.mapInArrow(run, schema)


def docx_text(files: DataFrame) -> DataFrame:
    """name, status, text of files(name, content): paragraphs of the main part of a word-processor document, one a line.
    status is read, or skipped for what is no such document, is damaged or unpacks to more than MOST_XML bytes; content is
    never changed."""

    def text_of(content) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
                xml = f.read(MOST_XML + 1)
                return None if len(xml) > MOST_XML else "\n".join(paragraphs(xml.decode("utf-8")))
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, KeyError, ValueError, TypeError, RuntimeError, struct.error):
            return None  # what damage to an archive raises, unknown compression and encryption (RuntimeErrors) included

    def row(name, content):
        text = text_of(content)
        return name, "skipped" if text is None else "read", text

    return each_row(files.select("name", "content"), row, "name string, status string, text string")


def as_docx(files: DataFrame) -> DataFrame:
    """name, content of files(name, content as text, broken): a minimal word-processor document each, a paragraph a line;
    where broken, an archive without the main part."""
    from html import escape

    def document(text, broken) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (text or "").split("\n"))
            z.writestr(zipfile.ZipInfo("word/none.xml" if broken else "word/document.xml"), f"<w:document><w:body>{lines}</w:body></w:document>")
        return out.getvalue()

    return each_row(files.select("name", "content", "broken"), lambda name, text, broken: (name, document(text, broken)), "name string, content binary")
