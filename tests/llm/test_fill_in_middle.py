import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import fill_in_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    """The transformation on a list of tokens."""
    text = text or ""
    t = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= 50 or re.search("<[PSM]>", text):
        return len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    return (len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab<>PSM é\U0001f600", max_size=40))
def test_cuts_by_runs_equal_cuts_by_tokens(text):
    t = UNIT.findall(text)
    ends, units = M.runs(text)
    assert (int(units[-1]) if len(units) else 0) == len(t)
    assert [M.offset(ends, units, u) for u in range(len(t) + 1)] == np.cumsum([0, *map(len, t)]).tolist()
    ends, units = M.runs(text, "char")
    assert [M.offset(ends, units, u) for u in range(len(text) + 1)] == list(range(len(text) + 1))
    for key in range(6):
        h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
        assert M.arranged(text, [int(h[i : i + 8], 16) for i in range(0, 32, 8)]) == plain(key, text)


TEXTS = [None, "", " ", "a", "  a  ", "\n\n", "a b\tc\nd ", "<", "S>", "x <P> y", "<S", "a<M>", "M> a <", "é 😀　x y z", "w " * 100_000, "x" * 100_000, "<<P >>S <M" * 50]


def test_rows(spark):
    rows = [(k, t, "clash", None) for k, t in enumerate(TEXTS * 5)] + [(None, "a b c", "x", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, `n.x` string")
    got = M.transform(df).withColumn("back", M.restored()).collect()
    want = sorted(((k, *plain(k, t), t or "") for k, t, _, _ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert M.transform(df.where("false")).count() == 0
    assert M.transform(df.where("doc_id = 3").withColumn("doc_id", F.lit("3"))).first().doc_id == "3"


def test_other_markers_and_rates(spark):
    df = spark.createDataFrame([(k, f"a b{k} <P> c") for k in range(50)], "doc_id long, text string")
    got = M.transform(df, markers=("[p]", "[s]", "[m]"), rate=100, spm_rate=0, unit="char").withColumn("back", M.restored(markers=("[p]", "[s]", "[m]"))).collect()
    assert {r.form for r in got} == {"psm"} and all(r.back == f"a b{r.doc_id} <P> c" and r.n == len(r.back) for r in got)
    with pytest.raises(ValueError, match="overlap"):
        M.transform(df, markers=("<P>", ">S<", "<M>"))
