import pathlib
import re

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_mixing", "op10_sharding", "op12_fill_in_middle", "op13_divergence"])
def test_matches_sql(spark, sf, name):
    assert_same(entry.queries()[name](spark, sf), entry.oracle_sql()[name], sf)


def test_nothing_else_imports_this_subpackage():
    root = pathlib.Path(entry.__file__).parent / "quarry"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "quarry.llm" not in f.read_text()
