import hashlib
from collections import Counter

import numpy as np
import sentencepiece

from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import mixing, piece_bpe, quality_rules
from quarry.llm import suffix_dedup as S
from quarry.llm.common import materialise
from tests.llm.test_setsketch import brute as near
from tests.llm.test_suffix_dedup import L

GOOD = """The river rose again in the night, and by morning the lower road was under water.
Nobody had slept much, but the boats were ready and the children had been carried up the hill.
Later the council wrote down which houses had lost their cellars, their hens or their winter wood.
An old engineer explained that a second sluice, once planned, had never been paid for."""


def words(seed, n=90):
    rng = np.random.default_rng(seed)
    w = ["".join(rng.choice(list("abcdefghinorst"), 5)) for _ in range(n)]
    return "\n".join(" ".join(w[k : k + 9]).capitalize() + "." for k in range(0, n, 9))


def table():
    rows = [(i, words(i), f"s{i % 3}") for i in range(30)]
    rows += [(40, rows[3][1], "s0"), (41, rows[4][1].replace(" ", "  "), "s1"), (42, rows[5][1] + " more words", None), (43, words(43) + "\n" + rows[6][1][:200], "s2"), (44, GOOD, "s2")]
    rows += [(50, None, "s1"), (51, "", None), (52, "too short", "s1"), (53, " ".join(w + "###" for w in words(53).split()), "s0"), (54, "same words here " * 60, "s0")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def brute(rows):
    """The pipeline's rows by plain means, but for the sampling of the mix, whose plan is taken from its operator."""
    rows = [r for r in rows if quality_rules.judged([r[1]])[-1][0]]
    kept = near([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if kept[r[0]][2]]
    first = {}
    data = {r[0]: r[1].encode() for r in rows}
    for i, b in data.items():
        for s in range(len(b) - L + 1):
            first[b[s : s + L]] = min(first.get(b[s : s + L], i), i)
    out = []
    for r in rows:
        b = data[r[0]]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - L + 1):
            if first[b[s : s + L]] < r[0]:
                gone[s : s + L] = True
        out.append((r[0], np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"), *r[2:]))
    return out


def test_run_against_plain(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table(), schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    before = brute(table())
    ids = {r[0] for r in before}
    assert ids >= set(range(30)) | {44} and not ids & {40, 41, 42, 50, 51, 52, 53, 54} and 43 in ids
    mixed = mixing.mix(spark.createDataFrame([(i, t, la, s, len(t)) for i, t, la, s, _ in before], schema)).collect()
    times = {r.doc_id: r.whole + (2 * r.extra >= max(r.size, 1)) for r in mixed}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, _, s, _ in before:
        got = library.encode(t)
        want[i, s, len(got), sha(",".join(map(str, got))), sha(library.decode(got))] += times[i]
    want = +want
    assert Counter(map(tuple, P.run(spark, str(tmp_path)).collect())) == want


def test_stages_return_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert [n for n, _ in P.STAGES] == ["quality rules", "near dedup", "repeated passages", "mixing", "encoding"]


def test_stages_with_extra_columns(spark, tmp_path):
    """Columns named as the operators name theirs pass through all stages but the last."""
    extra = ["kept", "part", "_key", "_id", "_crc", "size", "u", "r", "n", "component", "bucket", "id", "spans", "n_words"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(table()[:12] + table()[30:], schema)
    for k, c in enumerate(extra):
        docs = docs.withColumn(c, F.lit(k))
    docs = materialise(docs, "test-extra")
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), "test-extra")
        rows = docs.collect()
        assert rows and all(r[c] == k for r in rows for k, c in enumerate(extra)), name
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
