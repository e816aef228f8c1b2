"""Search requests: closed-schema validation on the backend's side, admission on the companion's side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clamped, identity, trimmed
from quarry.operators.hits import kind_of

FIELDS = ("query", "limit")
IDENTITY_FIELDS = ("user", "userId", "user_id", "userid", "uid")
MAX_LIMIT, DEFAULT_LIMIT = 100, 20


def validated(requests: DataFrame) -> DataFrame:
    """requests(body, user, ...) with code, query, limit. 400: an extra key names an identity; 422: any other fault of the
    body; 401: a sound body without identity; 200 else. Integers may come as whole decimals or digit strings."""
    v = F.try_parse_json("body")
    out = requests.withColumn("_v", v)
    is_object = F.coalesce(kind_of(F.col("_v")) == "OBJECT", F.lit(False))
    keys = F.when(is_object, F.json_object_keys("body"))
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS)))
    of = lambda name: F.when(is_object, F.try_variant_get("_v", f"$.{name}", "variant"))
    text = F.when(kind_of(of("query")) == "STRING", F.try_variant_get("_v", "$.query", "string"))
    kind = kind_of(of("limit"))
    raw = F.try_variant_get("_v", "$.limit", "string")
    whole = F.regexp_replace(F.btrim(raw), r"\.0+$", "")
    number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "STRING") & whole.rlike(r"^[+-]?[0-9]{1,18}$"), whole.try_cast("bigint")).when(kind == "BOOLEAN", F.try_variant_get("_v", "$.limit", "boolean").cast("int").cast("bigint"))
    limit = F.when(~F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), "limit"), F.lit(DEFAULT_LIMIT).cast("bigint")).otherwise(number)
    out = out.withColumn("_extra", extra).withColumn("_object", is_object).withColumn("query", text).withColumn("limit", limit)
    sound = F.col("_object") & (F.size("_extra") == 0) & F.coalesce(F.length("query") >= 1, F.lit(False)) & F.coalesce(F.col("limit").between(1, MAX_LIMIT), F.lit(False))
    smuggles = F.arrays_overlap("_extra", F.array(*map(F.lit, IDENTITY_FIELDS)))
    code = F.when(smuggles, 400).when(~sound, 422).when(identity("user").isNull(), 401).otherwise(200)
    out = out.withColumn("code", code)
    ok = F.col("code") == 200
    return out.select(*requests.columns, "code", F.when(ok, F.col("query")).alias("query"), F.when(ok, F.col("limit")).alias("limit"))


def admitted(requests: DataFrame, users: DataFrame, enabled: DataFrame) -> DataFrame:
    """Of requests(user_id, term, limit, ...) those with a term, a known user and the backend enabled for the user; term
    is trimmed and limit clamped."""
    out = requests.withColumn("term", trimmed("term")).where("term <> ''").withColumn("limit", clamped("limit", 1, MAX_LIMIT))
    return out.join(users.select("user_id"), "user_id", "left_semi").join(enabled.select("user_id"), "user_id", "left_semi").select(*requests.columns)
