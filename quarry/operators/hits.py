"""Answers of a search backend: triage, strict shape, cleaning, permission recheck, counters and rendering.

JSON is read as VARIANT, so one ill-typed element costs itself and not its array. `pos` carries the answer's order;
nothing is sorted, deduplicated or limited anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions.text import MAX_SNIPPET, MAX_TITLE, plain_text, relative_path, result_url

MAX_BODY = 1_048_576
#: The exact title under which a hit without a file is let through.
SENTINEL = "search container reached"


def kind_of(variant: Column) -> Column:
    """BIGINT, STRING, ARRAY, OBJECT, ... of a variant; null for none."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^[A-Z]+", 0)


def triage(answers: DataFrame) -> DataFrame:
    """answers(kind, status, body, ...) with verdict and results (variant, null unless the verdict is ok). kind 'error'
    is a failed transport. A body that repeats a key is no JSON here."""
    parsed = F.when(F.octet_length("body") <= MAX_BODY, F.try_parse_json("body"))
    out = answers.withColumn("_v", F.when((F.col("kind") != "error") & (F.col("status") < 400), parsed))
    out = out.withColumn("results", F.when(kind_of(F.col("_v")) == "OBJECT", F.try_variant_get("_v", "$.results", "variant")))
    verdict = (F.when(F.col("kind") == "error", "transport error").when(F.col("status") >= 400, "refused").when(F.col("body").isNull(), "no text")
               .when(F.octet_length("body") > MAX_BODY, "too large").when(F.col("_v").isNull() | ~kind_of(F.col("_v")).isin("ARRAY", "OBJECT"), "no JSON")
               .when(F.coalesce(kind_of(F.col("results")), F.lit("VOID")).isin("ARRAY", "OBJECT"), "ok").otherwise("no results"))
    out = out.withColumn("verdict", verdict)
    return out.withColumn("results", F.when(F.col("verdict") == "ok", F.col("results"))).drop("_v")


def elements(triaged: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, element of each element of the results."""
    v = triaged.where("verdict = 'ok'").select(*keys, "results")
    return v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("results").outer())).select(*keys, "pos", F.col("value").alias("element"))


def shaped(rows: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """rows(element variant, ...) with file_id, title, snippet and verdict: ok, sentinel (an id that can't be a file under
    the exact title; it becomes id 0) or dropped."""
    of = lambda name: F.try_variant_get("element", f"$.{name}", "variant")
    right = (kind_of(of("fileId")) == "BIGINT") & (kind_of(of("title")) == "STRING") & (kind_of(of("snippet")) == "STRING")
    out = rows.withColumn("_ok", F.coalesce(right, F.lit(False)))
    out = out.withColumn("file_id", F.when(F.col("_ok"), F.try_variant_get("element", "$.fileId", "bigint")))
    out = out.withColumn("title", F.when(F.col("_ok"), F.try_variant_get("element", "$.title", "string"))).withColumn("snippet", F.when(F.col("_ok"), F.try_variant_get("element", "$.snippet", "string")))
    clean = plain_text("snippet", MAX_SNIPPET)
    verdict = F.when(~F.col("_ok") | clean.isNull(), "dropped").when(F.col("file_id") > 0, "ok").when(F.col("title") == sentinel, "sentinel").otherwise("dropped")
    out = out.withColumn("verdict", verdict).withColumn("snippet", clean)
    return out.withColumn("file_id", F.when(F.col("verdict") == "sentinel", F.lit(0).cast("long")).otherwise(F.col("file_id"))).drop("_ok")


def visible(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    return hits.join(nodes.select("user_id", "file_id"), ["user_id", "file_id"], "left_semi")


def denied(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    return hits.join(nodes.select("user_id", "file_id"), ["user_id", "file_id"], "left_anti")


def permission_filter(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """user_id, pos, file_id, path, title, snippet of hits(user_id, pos, file_id, title, snippet) whose user sees the file.
    Title and path come from the node, the snippet from the answer. nodes has one row a (user_id, file_id)."""
    h = hits.select("user_id", "pos", "file_id", F.col("snippet").alias("_snippet")).where(F.is_valid_utf8("snippet"))
    n = nodes.select("user_id", "file_id", "name", "path").where(F.is_valid_utf8("name") & F.is_valid_utf8(F.coalesce("path", F.lit(""))))
    # What no node matches is never cleaned.
    both = h.join(n, ["user_id", "file_id"])
    return both.select("user_id", "pos", "file_id", plain_text(relative_path("path"), MAX_TITLE).alias("path"), plain_text("name", MAX_TITLE).alias("title"), plain_text("_snippet", MAX_SNIPPET).alias("snippet"))


def recheck(hits: DataFrame, nodes: DataFrame, folders: DataFrame) -> DataFrame:
    """user_id, answer_id, pos, verdict, file_id, path, title, snippet: the whole filter over shaped(...) rows with user_id
    and answer_id. An answer with a positive id of a user without a home folder (folders(user_id)) is lost whole, kept
    sentinels included; one without positive ids never asks for the folder. verdict: kept, dropped, unresolved or lost."""
    n = nodes.select("user_id", "file_id", F.col("name").alias("_name"), F.col("path").alias("_at"), F.lit(True).alias("_seen"))
    needs = hits.groupBy("user_id", "answer_id").agg(F.bool_or(F.col("verdict") == "ok").alias("_asks")).where("_asks").select("user_id", "answer_id")
    lost = needs.join(folders.select("user_id"), "user_id", "left_anti").withColumn("_lost", F.lit(True))
    out = hits.join(lost, ["user_id", "answer_id"], "left").join(n, ["user_id", "file_id"], "left")
    out = out.withColumn("_title", plain_text("_name", MAX_TITLE)).withColumn("_path", F.when(F.col("_seen"), plain_text(relative_path("_at"), MAX_TITLE)))
    verdict = (F.when(F.col("_lost"), "lost").when(F.col("verdict") == "dropped", "dropped").when(F.col("verdict") == "sentinel", "kept")
               .when(F.col("_seen").isNull(), "unresolved").when(F.col("_title").isNull() | F.col("_path").isNull(), "dropped").otherwise("kept"))
    ok = F.col("verdict") == "ok"
    return out.select("user_id", "answer_id", "pos", verdict.alias("outcome"), "file_id", F.when(ok, F.col("_path")).otherwise("").alias("path"), F.when(ok, F.col("_title")).otherwise(F.col("title")).alias("title"), "snippet")


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == s).alias(s) for s in ("dropped", "unresolved", "kept")]


def drop_counts(outcomes: DataFrame) -> DataFrame:
    """One row: dropped, unresolved, kept."""
    return outcomes.agg(*_counts())


def counted(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of drop_counts' numbers, which the job that writes the rows fills on its way: nothing
    is read or joined a second time. Its get waits for that job. The numbers are those of the tasks that count, if no stage
    stands between them and the result; so what follows here may be filtered and written, but not shuffled."""
    seen = Observation()
    return outcomes.observe(seen, *_counts()), seen


def entries(hits: DataFrame, icon: str = "icon-search") -> DataFrame:
    """Rendered rows: thumbnail, title, subline, url, icon, and what identifies them."""
    keep = [c for c in ("user_id", "pos", "file_id") if c in hits.columns]
    return hits.select(*keep, F.lit("").alias("thumbnail"), "title", F.col("snippet").alias("subline"), result_url("file_id").alias("url"), F.lit(icon).alias("icon"))


def envelope(hits: DataFrame) -> DataFrame:
    """One row, body: the JSON answer of a page of hits. A page is bounded by the request's limit."""
    fields = F.struct(F.col("file_id").alias("fileId"), "path", "title", "snippet")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", fields.alias("hit")))), lambda x: x["hit"])
    return hits.agg(F.to_json(F.struct(rows.alias("results"))).alias("body"))


def sentinel_hit(user: Column, host: Column, at: Column, title: str = SENTINEL) -> list[Column]:
    """The columns of the one-row answer that proves where it was made. at is a time without zone, in UTC."""
    from quarry.functions.text import epoch_seconds, iso_seconds

    text = F.concat(F.lit("produced inside container "), host, F.lit(" at "), iso_seconds(at), F.lit(" for user "), user)
    return [F.lit(0).cast("long").alias("file_id"), F.lit("").alias("path"), F.lit(title).alias("title"), text.alias("snippet"), F.array().cast("array<struct<start:int,end:int>>").alias("highlights"), F.lit(0.0).alias("score"), epoch_seconds(at).alias("mtime")]


def without_markup(snippet: str = "snippet") -> Column:
    return ~(F.contains(F.col(snippet), F.lit("<")) | F.contains(F.col(snippet), F.lit(">")))
