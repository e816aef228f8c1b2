"""A corpus from `documents`: quality rules, near and repeated text removed, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs. All but
the last return the columns of documents, in their order and whatever else the table has, also if a name is one that an
operator uses. What a stage wrote on its way is deleted when its result is written; the results stay.

Defined results, for all stages: an empty table gives an empty one. Null, empty and short texts fail the base rules, so the
stages after the first see none unless they are called alone; then near dedup keeps them (they are linked with nothing),
passages leave them, the mix never takes them (size 0) and encoding gives no ids. A null doc_id or source is kept: such rows
are never near copies of others by id, count as the last document for passages, and are a source of their own. Repeated
rows: one stays after near dedup. Ties: the smaller doc_id stays, or owns a passage; the mix orders by a seeded hash, then
doc_id. Very long texts are judged, compared, cut, taken and encoded whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, piece_bpe, quality_rules, setsketch, suffix_dedup
from quarry.llm.common import materialise, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labels or the base rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return setsketch.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has too are cut out; every document stays."""
    return suffix_dedup.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text, one row for each row of docs."""
    return piece_bpe.encode_digests(docs, piece_bpe.default_model(), carry=["source"])


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("repeated passages", repeated_passages),
    ("mixing", mix),
    ("encoding", encode),
]

#: Python decides in every stage but one: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        begun = len(written(spark))
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
            release(spark, written(spark)[begun:-1])
    return docs
