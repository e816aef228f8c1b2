"""The registered queries over the driver's tables, each with the SQL that a second engine answers the same way."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import content, german, hits, index, manifest, queue, requests, rules, search, status, tree
from quarry.plans import tables as T
from quarry.session import shared_folder
from quarry.sources import config, corpus_sink, files, ids, sinks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    """v as SQL that DuckDB reads."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]::VARCHAR[]"
    parts = ["chr(%d)" % ord(c) if ord(c) < 32 or ord(c) in (0x7F, 0x85, 0xA0, 0x202E, 0x2028, 0x200B) else None for c in v]
    if not any(parts):
        return "'" + v.replace("'", "''") + "'"
    return "(" + " || ".join(p or "'" + c.replace("'", "''") + "'" for p, c in zip(parts, v)) + ")"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


# Content scans ------------------------------------------------------------------------------------------------------

STATUS_SQL = f"""{T.FILES_SQL}, {T.REQUESTS_SQL},
results AS (SELECT r.user_id, r.file_id,
    CASE WHEN f.http_status IS NULL OR f.http_status IN (404, 998) THEN 'not-accessible' WHEN f.http_status >= 400 THEN 'error' ELSE 'read' END AS status,
    CASE WHEN f.http_status < 400 THEN coalesce(strlen(f.content), 0) ELSE 0 END::BIGINT AS bytes_read,
    CASE WHEN f.http_status >= 400 AND f.http_status NOT IN (404, 998) THEN 'HTTPStatusError' ELSE '' END AS detail
  FROM requests r LEFT JOIN files f ON r.user_id = f.user_id AND r.file_id = f.file_id)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_read(T.read_requests(spark, sf_dir), T.files(spark, sf_dir))


@query(f"WITH {STATUS_SQL} SELECT * FROM results")
def content_read_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir)


@query(f"""WITH {STATUS_SQL} SELECT count(*) AS files, count(*) FILTER (status = 'read') AS read,
  count(*) FILTER (status = 'not-accessible') AS not_accessible, count(*) FILTER (status = 'error') AS error,
  coalesce(sum(bytes_read), 0)::BIGINT AS bytes FROM results""")
def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.summary(results(spark, sf_dir))


@query(f"""WITH {STATUS_SQL}, s(status) AS (VALUES ('read'), ('not-accessible'), ('error'))
SELECT s.status, count(r.status) AS n FROM s LEFT JOIN results r ON r.status = s.status GROUP BY s.status""")
def read_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.status_counts(results(spark, sf_dir))


@query(f"WITH {STATUS_SQL} SELECT CASE WHEN coalesce(bool_or(status = 'error'), false) THEN 1 ELSE 0 END::INT AS exit_code FROM results")
def read_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.exit_code(results(spark, sf_dir))


@query(f"""WITH {STATUS_SQL} SELECT 'file ' || file_id || ' ' || status || ' bytes=' || bytes_read
  || CASE WHEN detail <> '' THEN ' detail=' || detail ELSE '' END AS line FROM results
UNION ALL SELECT 'summary files=' || count(*) || ' read=' || count(*) FILTER (status = 'read') || ' not-accessible=' || count(*) FILTER (status = 'not-accessible')
  || ' error=' || count(*) FILTER (status = 'error') || ' bytes=' || coalesce(sum(bytes_read), 0)::BIGINT FROM results""")
def read_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.select(content.report_line().alias("line")).unionAll(content.summary_line(content.summary(r)))


@query("""WITH n AS (SELECT doc_id, source, text FROM documents)
SELECT e.event_id, CASE WHEN e.event_type = 'error' THEN 403 WHEN n.doc_id IS NULL OR n.source = 'src0' THEN 404
  WHEN length(n.text) < 500 THEN 422 WHEN e.event_type = 'signup' AND length(n.text) < 1000 THEN 500 ELSE 200 END::INT AS code
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS file_id FROM events) e
LEFT JOIN n ON n.doc_id = e.file_id AND n.source = 'src' || (e.user_id % 20)""")
def gateway_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask for the file that props names, as user src0 to src19; errors come from a foreign caller. src0's nodes are
    folders, short texts don't open, and a signup fails on texts of medium length."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "signup", "backend ").otherwise("backend").alias("kind"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("user_id"), F.get_json_object("props", "$.k").cast("bigint").alias("file_id"))
    d = T.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("file_id"), (F.col("source") != "src0").alias("is_file"), (F.length("text") >= 500).alias("opens"), (F.length("text") < 1000).alias("_medium"))
    asked = e.withColumn("caller", F.trim("kind"))
    plain = content.gateway_verdict(asked.where("kind <> 'backend '"), d.withColumn("fails", F.lit(False)), "backend")
    signups = content.gateway_verdict(asked.where("kind = 'backend '"), d.withColumn("fails", F.col("_medium")), "backend")
    return plain.unionByName(signups).select("event_id", "code")


@query("""SELECT doc_id AS file_id, b::INT AS block_no, least(4096, strlen(text) - b * 4096)::BIGINT AS block_bytes,
  least(strlen(text), (b + 1) * 4096)::BIGINT AS running_bytes
FROM documents, LATERAL (SELECT unnest(range((strlen(text) + 4095) // 4096)) AS b) WHERE strlen(text) > 0""")
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return content.content_blocks(d, 4096).select("file_id", "block_no", F.octet_length("block").cast("long").alias("block_bytes"), "running_bytes")


# Hits ---------------------------------------------------------------------------------------------------------------

UNSAFE_SQL = r"[\x00-\x08\x0A-\x1F\x7F-\x9F\p{Cf}\x{2028}\x{2029}]"


def clean_sql(value: str, limit: int) -> str:
    return f"substring(regexp_replace({value}, '{UNSAFE_SQL}', '', 'g'), 1, {limit})"


@query(f"""WITH {T.HITS_SQL}, {T.NODES_SQL}
SELECT h.user_id, h.pos, h.file_id, {clean_sql("ltrim(n.path, '/')", 255)} AS path, {clean_sql('n.name', 255)} AS title, {clean_sql('h.snippet', 1000)} AS snippet
FROM hits h JOIN nodes n ON h.user_id = n.user_id AND h.file_id = n.file_id""")
def permission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.permission_filter(T.hits(spark, sf_dir), T.nodes(spark, sf_dir))


@query(f"WITH {T.HITS_SQL}, {T.NODES_SQL} SELECT user_id, pos, file_id FROM hits h WHERE EXISTS (FROM nodes n WHERE n.user_id = h.user_id AND n.file_id = h.file_id)")
def permission_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.visible(T.hits(spark, sf_dir), T.nodes(spark, sf_dir)).select("user_id", "pos", "file_id")


@query(f"WITH {T.HITS_SQL}, {T.NODES_SQL} SELECT user_id, pos, file_id FROM hits h WHERE NOT EXISTS (FROM nodes n WHERE n.user_id = h.user_id AND n.file_id = h.file_id)")
def permission_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.denied(T.hits(spark, sf_dir), T.nodes(spark, sf_dir)).select("user_id", "pos", "file_id")


TEXTS = [(-1, "a\x07b\nc\td"), (-2, "left" + chr(0x202E) + "right" + chr(0x2028) + "line" + chr(0x200B) + "zero"), (-3, "\x7f\x85\xa0kept"), (-4, chr(0x1F600) * 1001), (-5, ""), (-6, None), (-7, "x" * 256)]


@query(f"""WITH {values('inline', ['doc_id', 'text'], TEXTS)}, t AS (SELECT doc_id, text FROM documents UNION ALL FROM inline)
SELECT doc_id, {clean_sql('text', 255)} AS title, {clean_sql('text', 1000)} AS snippet FROM t""")
def plain_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    return t.select("doc_id", X.plain_text("text", X.MAX_TITLE).alias("title"), X.plain_text("text", X.MAX_SNIPPET).alias("snippet"))


S = hits.SENTINEL
ELEMENTS = [
    (-1, '{"fileId": 5, "title": "a", "snippet": "b", "score": 1.5, "more": [1]}'), (-2, '{"fileId": "5", "title": "a", "snippet": "b"}'), (-3, '{"fileId": 5.0, "title": "a", "snippet": "b"}'),
    (-4, '{"fileId": true, "title": "a", "snippet": "b"}'), (-5, '{"fileId": 12345678901234567890, "title": "a", "snippet": "b"}'), (-6, '{"fileId": null, "title": "a", "snippet": "b"}'),
    (-7, '{"title": "a", "snippet": "b"}'), (-8, '{"fileId": 5, "title": null, "snippet": "b"}'), (-9, '{"fileId": 5, "title": "a"}'), (-10, '{"fileId": 5, "title": "a", "snippet": 7}'), (-11, '[5, "a", "b"]'), (-12, '"text"'),
    (-13, '{"fileId": 0, "title": "' + S + '", "snippet": "b"}'), (-14, '{"fileId": -3, "title": "' + S + '", "snippet": "b"}'), (-15, '{"fileId": 0, "title": "' + S + ' ", "snippet": "b"}'), (-16, '{"fileId": -3, "title": "a", "snippet": "b"}'), (-17, "null"), (-18, "17"),
]

#: Each kind of event writes its hit in a way of its own.
ELEMENT_FORMS = {
    "view": '{"fileId": %s, "title": "view", "snippet": "seen"}', "click": '{"fileId": -%s, "title": "' + S + '", "snippet": "clicked"}',
    "purchase": '{"fileId": %s.0, "title": "bought", "snippet": "s"}', "signup": '{"fileId": "%s", "title": "new", "snippet": "s"}', "error": '{"k": %s}',
}


def _form(kind: str, sql: bool):
    a, b = ELEMENT_FORMS[kind].split("%s")
    return f"{literal(a)} || json_extract_string(props, '$.k') || {literal(b)}" if sql else F.concat(F.lit(a), F.get_json_object("props", "$.k"), F.lit(b))


ELEMENTS_SQL = f"""{values('inline', ['id', 'j'], ELEMENTS)}, elements AS (FROM inline UNION ALL SELECT event_id,
  CASE event_type {' '.join(f"WHEN '{k}' THEN {_form(k, True)}" for k in ELEMENT_FORMS)} END FROM events),
typed AS (SELECT id, j, json_type(j) = 'OBJECT' AND json_type(j, '$.title') = 'VARCHAR' AND json_type(j, '$.snippet') = 'VARCHAR'
    AND json_type(j, '$.fileId') IN ('BIGINT', 'UBIGINT') AND try_cast(json_extract_string(j, '$.fileId') AS BIGINT) IS NOT NULL AS ok FROM elements),
shaped AS (SELECT id, CASE WHEN ok THEN json_extract_string(j, '$.fileId')::BIGINT END AS f, CASE WHEN ok THEN json_extract_string(j, '$.title') END AS title,
    CASE WHEN ok THEN json_extract_string(j, '$.snippet') END AS snippet,
    CASE WHEN ok IS NOT TRUE THEN 'dropped' WHEN json_extract_string(j, '$.fileId')::BIGINT > 0 THEN 'ok' WHEN json_extract_string(j, '$.title') = '{S}' THEN 'sentinel' ELSE 'dropped' END AS verdict FROM typed),
hits AS (SELECT id, verdict, CASE WHEN verdict = 'sentinel' THEN 0 ELSE f END AS file_id, title, snippet FROM shaped)"""


def shaped_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    form = F.lit(None).cast("string")
    for k in ELEMENT_FORMS:
        form = F.when(F.col("event_type") == k, _form(k, False)).otherwise(form)
    rows = e.select(F.col("event_id").alias("id"), form.alias("j")).unionAll(spark.createDataFrame(ELEMENTS, "id long, j string"))
    return hits.shaped(rows.select("id", F.try_parse_json("j").alias("element")))


@query(f"WITH {ELEMENTS_SQL} SELECT id, verdict, coalesce(file_id, 0)::BIGINT AS file_id, title, snippet FROM hits")
def hit_shape_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that is none shows as 0."""
    return shaped_elements(spark, sf_dir).select("id", "verdict", F.coalesce("file_id", F.lit(0).cast("long")).alias("file_id"), "title", "snippet")


@query(f"""WITH {ELEMENTS_SQL}, {T.NODES_SQL}, seen AS (SELECT DISTINCT file_id FROM nodes)
SELECT count(*) FILTER (verdict = 'dropped') AS dropped, count(*) FILTER (verdict = 'ok' AND s.file_id IS NULL) AS unresolved,
  count(*) FILTER (verdict = 'sentinel' OR verdict = 'ok' AND s.file_id IS NOT NULL) AS kept FROM hits h LEFT JOIN seen s ON h.file_id = s.file_id""")
def hit_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits are one answer to a user who sees every labelled document."""
    n = T.nodes(spark, sf_dir).withColumn("user_id", F.lit("all"))
    h = shaped_elements(spark, sf_dir).withColumn("user_id", F.lit("all")).withColumn("answer_id", F.lit(1)).withColumn("pos", F.col("id"))
    return hits.drop_counts(hits.recheck(h, n, spark.createDataFrame([("all",)], "user_id string")))


ANSWERS = [(1, "response", 200, '{"results": [{"fileId": 5}, 7, null]}'), (2, "response", 200, '{"results": {"a": 1, "b": 2}}'), (3, "error", 200, '{"results": []}'), (4, "response", 503, '{"results": [1]}'), (5, "response", 302, '{"results": []}'),
           (6, "response", 200, None), (7, "response", 200, "no json"), (8, "response", 200, "17"), (9, "response", 200, "{}"), (10, "response", 200, '{"results": null}'), (11, "response", 200, '{"results": 3}'), (12, "response", 200, "[1, 2]"), (13, "response", 399, '{"results": ["x", [1, 2], {"y": null}]}')]
BODY_HEAD, BODY_TAIL = '{"results": ["', '"]}'
PADDING = hits.MAX_BODY - len(BODY_HEAD) - len(BODY_TAIL)

ANSWERS_SQL = f"""{values('inline', ['id', 'kind', 'status', 'body'], ANSWERS)}, answers AS (FROM inline
  UNION ALL SELECT 100, 'response', 200, '{BODY_HEAD}' || repeat('x', {PADDING}) || '{BODY_TAIL}' UNION ALL SELECT 101, 'response', 200, '{BODY_HEAD}' || repeat('x', {PADDING + 1}) || '{BODY_TAIL}'
  UNION ALL SELECT 1000 + event_id, 'response', CASE WHEN event_type = 'error' THEN 500 ELSE 200 END, '{{"results": [' || props || ', ' || event_id || ']}}' FROM events),
v AS (SELECT *, CASE WHEN kind = 'error' THEN 'transport error' WHEN status >= 400 THEN 'refused' WHEN body IS NULL THEN 'no text' WHEN strlen(body) > 1048576 THEN 'too large'
  WHEN NOT json_valid(body) THEN 'no JSON' WHEN json_type(body) NOT IN ('ARRAY', 'OBJECT') THEN 'no JSON'
  WHEN json_type(body) = 'OBJECT' AND coalesce(json_type(body, '$.results'), 'NULL') IN ('ARRAY', 'OBJECT') THEN 'ok' ELSE 'no results' END AS verdict FROM answers)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = spark.createDataFrame(ANSWERS, "id long, kind string, status int, body string")
    big = spark.range(2).select((F.col("id") + 100).alias("id"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.concat(F.lit(BODY_HEAD), F.repeat(F.lit("x"), (F.col("id") + PADDING).cast("int")), F.lit(BODY_TAIL)).alias("body"))
    e = T.table(spark, sf_dir, "events")
    e = e.select((F.col("event_id") + 1000).alias("id"), F.lit("response").alias("kind"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.concat(F.lit('{"results": ['), "props", F.lit(", "), F.col("event_id").cast("string"), F.lit("]}")).alias("body"))
    return hits.triage(inline.unionAll(big).unionAll(e))


@query(f"""WITH {ANSWERS_SQL}, counted AS (SELECT id, verdict, CASE WHEN verdict = 'ok' THEN CASE WHEN json_type(body, '$.results') = 'ARRAY' THEN json_array_length(body, '$.results') ELSE len(json_keys(body, '$.results')) END ELSE 0 END::BIGINT AS n FROM v)
SELECT id, verdict, n FROM counted""")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    n = hits.elements(a, "id").groupBy("id").agg(F.count("*").alias("n"))
    return a.select("id", "verdict").join(n, "id", "left").select("id", "verdict", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {ANSWERS_SQL} SELECT v.id, (row_number() OVER (PARTITION BY v.id ORDER BY e.rowid) - 1)::INT AS pos,
  CASE e.type WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE 'BIGINT' END AS kind
FROM v, json_each(CASE WHEN verdict = 'ok' THEN body ELSE '{{"results": []}}' END, '$.results') e WHERE v.verdict = 'ok'""")
def response_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.elements(answers(spark, sf_dir), "id").select("id", "pos", hits.kind_of(F.col("element")).alias("kind"))


@query("""SELECT doc_id AS file_id, '' AS thumbnail, source AS title, substring(lang, 1, 5) AS subline,
  CASE WHEN doc_id <= 0 THEN '/files' ELSE '/f/' || doc_id END AS url, 'icon-search' AS icon FROM documents""")
def result_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.entries(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("title"), F.col("lang").alias("snippet")))


@query("""SELECT 0::BIGINT AS file_id, '' AS path, 'search container reached' AS title, 'produced inside container node-1 at 2024-05-06T07:08:09+00:00 for user ' || n_name AS snippet,
  0.0::DOUBLE AS score, epoch(TIMESTAMP '2024-05-06 07:08:09')::BIGINT AS mtime, 0::INT AS n_highlights FROM nation""")
def sentinel_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(dt.datetime(2024, 5, 6, 7, 8, 9, 123456)).cast("string").cast("timestamp_ntz")
    h = T.table(spark, sf_dir, "nation").select(*hits.sentinel_hit(F.col("n_name"), F.lit("node-1"), at))
    return h.select("file_id", "path", "title", "snippet", "score", "mtime", F.size("highlights").alias("n_highlights"))


# Requests -----------------------------------------------------------------------------------------------------------

BODIES = [(-1, '{"query":"contract"}', "alice"), (-2, '{"query":"contract","userId":"bob"}', "alice"), (-3, '{"query":"contract","limitt":5}', "alice"), (-4, '{"query":"contract","limit":0}', "alice"), (-5, '{"query":"contract","limit":101}', "alice"),
          (-6, '{"query":"contract"}', ""), (-7, '{"query":"contract"}', None), (-8, '{"query":""}', "alice"), (-9, '{"query":5}', "alice"), (-10, '{"limit":5}', "alice"), (-11, "[1]", "alice"), (-12, "nothing", "alice"),
          (-13, '{"query":"a","limit":null}', "alice"), (-14, '{"query":" ","limit":100}', "alice"), (-15, '{"query":"a","limit":1.5}', "alice"), (-16, '{"uid":1}', ""), (-17, '{"query":"a","limit":"7"}', "alice")]
BODIES_SQL = f"""{values('inline', ['id', 'body', 'who'], BODIES)}, bodies AS (FROM inline UNION ALL SELECT event_id,
  CASE event_type WHEN 'view' THEN '{{"query": "' || event_type || '", "limit": ' || user_id || '}}' WHEN 'click' THEN '{{"query": "q", "user": ' || user_id || '}}' WHEN 'error' THEN props ELSE '{{"query": "' || event_type || '"}}' END,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE user_id::VARCHAR END FROM events)"""


@query(f"""WITH {BODIES_SQL}, p AS (SELECT *, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' THEN body END AS j FROM bodies),
q AS (SELECT *, list_filter(json_keys(j), lambda k: k NOT IN ('query', 'limit')) AS extra, CASE WHEN json_type(j, '$.query') = 'VARCHAR' THEN json_extract_string(j, '$.query') END AS t,
  CASE WHEN json_type(j, '$.limit') IS NULL THEN 20 ELSE try_cast(CASE WHEN regexp_full_match(json_extract_string(j, '$.limit'), '[+-]?[0-9]+') THEN json_extract_string(j, '$.limit') END AS BIGINT) END AS l FROM p),
c AS (SELECT *, CASE WHEN j IS NOT NULL AND list_has_any(extra, ['user', 'userId', 'user_id', 'userid', 'uid']) THEN 400
  WHEN j IS NULL OR len(extra) > 0 OR t IS NULL OR length(t) < 1 OR l IS NULL OR l NOT BETWEEN 1 AND 100 THEN 422 WHEN coalesce(who, '') = '' THEN 401 ELSE 200 END::INT AS code FROM q)
SELECT id, code, CASE WHEN code = 200 THEN t END AS query, CASE WHEN code = 200 THEN l ELSE 0 END::BIGINT AS "limit" FROM c""")
def request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    body = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"query": "'), "event_type", F.lit('", "limit": '), user, F.lit("}")))
            .when(F.col("event_type") == "click", F.concat(F.lit('{"query": "q", "user": '), user, F.lit("}"))).when(F.col("event_type") == "error", F.col("props")).otherwise(F.concat(F.lit('{"query": "'), "event_type", F.lit('"}'))))
    rows = e.select(F.col("event_id").alias("id"), body.alias("body"), F.when(F.col("user_id") % 10 == 0, "").otherwise(user).alias("user")).unionAll(spark.createDataFrame(BODIES, "id long, body string, user string"))
    return requests.validated(rows).select("id", "code", "query", F.coalesce("limit", F.lit(0).cast("long")).alias("limit"))


@query("""SELECT e.event_id, e.user_id, e.event_type AS term, greatest(1, least(100, e.user_id - 20))::BIGINT AS "limit" FROM events e
WHERE e.event_type <> 'signup' AND EXISTS (FROM supplier s WHERE s.s_suppkey = e.user_id) AND EXISTS (FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING')""")
def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are the known users; the backend is enabled for customers of one segment. Signups have a blank term."""
    e = T.table(spark, sf_dir, "events")
    term = F.when(F.col("event_type") == "signup", F.lit(" \t\n\x0b")).otherwise(F.concat(F.lit("\t "), "event_type", F.lit(" \r\n")))
    rows = e.select("event_id", "user_id", term.alias("term"), (F.col("user_id") - 20).alias("limit"))
    users = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    enabled = T.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return requests.admitted(rows, users, enabled)


# Scalars ------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS mtime, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events""")
def event_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select("event_id", X.epoch_seconds("ts").alias("mtime"), X.iso_seconds("ts").alias("iso"))


URLS = [(-1, "https://host/"), (-2, "https://host/index.php"), (-3, "https://host/index.php/"), (-4, "https://host//"), (-5, None), (-6, "https://host/a/index.php/index.php"), (-7, "/"), (-8, "https://host//index.php//")]


@query(f"""WITH {values('inline', ['page_id', 'url'], URLS)}, p AS (SELECT page_id, url FROM pages UNION ALL FROM inline)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '/$', ''), '/index\\.php$', ''), '/$', '') || '/content/' || page_id AS url FROM p""")
def gateway_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages").select("page_id", "url").unionAll(spark.createDataFrame(URLS, "page_id long, url string"))
    return p.select("page_id", X.content_url("url", "page_id").alias("url"))


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'files.' || url WHEN page_id % 3 = 1 THEN url ELSE 'files' END AS route FROM pages)
SELECT page_id, CASE WHEN starts_with(route, 'files.') THEN -5 ELSE 25 END::INT AS position FROM r""")
def provider_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages")
    route = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("files."), "url")).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("files")
    return p.select("page_id", X.provider_order(route).alias("position"))


@query("SELECT page_id, base64(encode(url || ':' || 'secret' || page_id)) AS credential FROM pages")
def auth_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.headers("url", F.concat(F.lit("secret"), F.col("page_id").cast("string")), F.lit("app"), F.lit("1"))
    return T.table(spark, sf_dir, "pages").select("page_id", h["AUTHORIZATION-APP-API"].alias("credential"))


SETTINGS = [(1, None, None, None, None, None, None, None), (2, " Debug ", None, "8080", None, None, "FALSE", "12.5"), (3, "verbose", "key", None, None, None, "0", " 7 "), (4, "ERROR", "key", "x", "/run/s.sock", None, "1", "never"),
            (5, "info", "", "80a", None, "::1", "TRUE", "1_0"), (6, "critical", None, "", None, "0.0.0.0", "/etc/bundle.pem", "1d"), (7, "Warning\n", None, "12", None, None, "yes", "1e2"), (8, "", "", "9", None, None, "", ""), (9, "info", None, "0", None, None, "true", "-3")]


#: Settings of a deployment for each event, of its own values: case and white space, missing, empty and wrong ones.
EVENT_SETTINGS = {
    "log_level": "CASE WHEN value < 30 THEN NULL ELSE ' ' || upper(event_type) || ' ' END",
    "tunnel_key": "CASE WHEN value < 20 THEN NULL WHEN value < 80 THEN '' ELSE 'key' END",
    "port": "CASE WHEN user_id < 300 THEN NULL WHEN event_type = 'click' THEN props ELSE cast(user_id AS {text}) END",
    "socket": "CASE WHEN event_type = 'view' THEN NULL ELSE '/run/' || event_type || '.sock' END",
    "host": "CASE WHEN user_id < 600 THEN NULL ELSE 'host' || user_id END",
    "tls": "CASE event_type WHEN 'view' THEN 'FALSE' WHEN 'click' THEN '0' WHEN 'error' THEN 'True' WHEN 'signup' THEN NULL ELSE '/etc/' || user_id || '.pem' END",
    "timeout": "CASE event_type WHEN 'view' THEN 'never' WHEN 'signup' THEN NULL WHEN 'error' THEN props WHEN 'click' THEN ' ' || user_id || '.5 ' ELSE '1_' || user_id END",
}
_EVENT_SETTINGS_SQL = ", ".join(f"{v.replace('{text}', 'VARCHAR')} AS {c}" for c, v in EVENT_SETTINGS.items())


@query(f"""WITH {values('fixed', ['id', *config.COLUMNS], SETTINGS)}, c AS (SELECT * FROM fixed UNION ALL SELECT 100 + event_id, {_EVENT_SETTINGS_SQL} FROM events)
SELECT id::BIGINT AS id, CASE WHEN lower(trim(log_level, E' \\n\\t')) IN ('debug', 'info', 'warning', 'error', 'critical') THEN lower(trim(log_level, E' \\n\\t')) ELSE 'info' END AS log_level,
  CASE WHEN coalesce(tunnel_key, '') = '' AND NOT regexp_full_match(coalesce(port, ''), '[0-9]+') THEN 'port' END AS problem,
  CASE WHEN coalesce(tunnel_key, '') <> '' THEN 'unix socket ' || coalesce(socket, '/tmp/app.sock') || ' (tunnel)' ELSE 'tcp ' || coalesce(host, '127.0.0.1') || ':' || coalesce(port, 'unset') END AS binding,
  CASE WHEN lower(coalesce(tls, 'true')) IN ('false', '0') THEN 'false' WHEN lower(coalesce(tls, 'true')) IN ('true', '1') THEN 'true' ELSE tls END AS tls,
  CASE WHEN timeout IS NULL THEN 90.0 WHEN regexp_full_match(timeout, ' *[+-]?[0-9][0-9_]*\\.?[0-9]*(e[0-9]+)? *') THEN replace(trim(timeout), '_', '')::DOUBLE END::DOUBLE AS timeout FROM c""")
def config_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(SETTINGS, "id long, " + ", ".join(f"{c} string" for c in config.COLUMNS))
    of_events = T.table(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("id"), *[F.expr(v.replace("{text}", "string")).alias(c) for c, v in EVENT_SETTINGS.items()])
    return config.normalised(fixed.unionByName(of_events))


# Manifests and ids --------------------------------------------------------------------------------------------------


@query("SELECT 'document ' || doc_id AS name, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_named(T.table(spark, sf_dir, "documents")))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))


@query("SELECT count(*) AS files, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents")
def corpus_manifest_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(F.octet_length("text").alias("bytes")).transform(manifest.total)


CHANGED_SQL = """before AS (SELECT 'document ' || doc_id AS name, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents),
after AS (SELECT 'document ' || doc_id AS name, strlen(t) AS bytes, sha256(t) AS sha256 FROM
    (SELECT doc_id, CASE WHEN toxic = 1 THEN text || '!' ELSE text END AS t FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 0)
  UNION ALL SELECT 'page ' || page_id, strlen(html), sha256(html) FROM pages),
d AS (SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN a.bytes = b.bytes AND a.sha256 = b.sha256 THEN 'same' ELSE 'changed' END AS change
  FROM before b FULL JOIN after a ON a.name = b.name)"""


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests before and after: bad documents went, toxic ones changed, pages came."""
    docs = T.table(spark, sf_dir, "documents")
    later = docs.join(T.table(spark, sf_dir, "labels"), "doc_id", "left").where("quality IS NULL OR quality <> 0")
    later = later.withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    pages = T.table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("content"))
    return manifest.manifest(_named(docs)), manifest.manifest(_named(later).unionAll(pages))


@query(f"WITH {CHANGED_SQL} SELECT * FROM d")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff(*_changed(spark, sf_dir))


@query(f"WITH {CHANGED_SQL} SELECT count(*) FILTER (change <> 'added') AS before, count(*) FILTER (change <> 'removed') AS after, coalesce(bool_and(change = 'same'), true) AS unchanged FROM d")
def manifest_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.unchanged(*_changed(spark, sf_dir))


@query("SELECT 0::INT AS part, doc_id AS pos, doc_id AS file_id FROM documents UNION ALL SELECT 1::INT, doc_id, doc_id FROM labels")
def ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: T.table(spark, sf_dir, t).select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("file_id"))
    return ids.union(of("documents"), of("labels"))


ID_FILES = [("good", " 11\n12\t13\r\n\x0c14 "), ("word", "11 not-a-number 13"), ("zero", "11 0 13"), ("minus", "-5"), ("none", " \n "), ("large", "9223372036854775807 9223372036854775808 007"), ("signs", "+5 7.0 1_0"), ("wide", "1\xa02\x1c3\x854")]


_TOKEN_OF_ORDER = "CASE o_orderstatus WHEN 'F' THEN '00' || o_orderkey WHEN 'P' THEN o_orderkey || '.0' ELSE '' || o_orderkey END"


@query(f"""WITH {values('fixed', ['name', 'content'], ID_FILES)}, f AS (SELECT * FROM fixed UNION ALL SELECT 'customer ' || o_custkey, ' ' || string_agg({_TOKEN_OF_ORDER}, chr(10) || ' ' ORDER BY o_orderkey) FROM orders GROUP BY o_custkey), t AS (SELECT name, list_filter(regexp_split_to_array(content, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}]+'), lambda x: x <> '') AS ts FROM f),
u AS (SELECT name, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM t)
SELECT name, pos::INT AS pos, token, CASE WHEN regexp_full_match(token, '[0-9]+') AND try_cast(token AS BIGINT) > 0 THEN try_cast(token AS BIGINT) ELSE 0 END::BIGINT AS file_id FROM u""")
def ids_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer with the keys of its orders; some are written as no id can be. Such a token shows as 0."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.expr(_TOKEN_OF_ORDER).alias("token")))), lambda x: x["token"])
    of_orders = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit(" "), F.array_join(lines, "\n ")).alias("content"))
    of_orders = of_orders.select(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name"), "content")
    p = ids.parse(spark.createDataFrame(ID_FILES, "name string, content string").unionByName(of_orders))
    return p.withColumn("file_id", F.coalesce("file_id", F.lit(0).cast("long")))


# Rules --------------------------------------------------------------------------------------------------------------

NODES = [("app/client.py", 3, "import", "httpx", None, None, None), ("app/views.py", 1, "import", "httpx.client", None, None, None), ("app/views.py", 2, "import", "httpxx", None, None, None), ("app\\jobs.py", 4, "import", "nc_py_api", None, None, None),
         ("app/client.py", 9, "identifier", "set_user", None, None, None), ("app/views.py", 9, "identifier", "uploads", None, None, None), ("app/views.py", 12, "call", "ocs", "nc", "put", "/x"), ("app/views.py", 13, "call", "request", "nc._session", None, None),
         ("app/views.py", 14, "call", "request", "index", None, "/y"), ("app/views.py", 15, "call", "ocs", "nc", "GET", "/x"), ("app/views.py", 16, "call", "delete", "session", "/ok", None), ("app/views.py", 16, "identifier", "delete", None, None, None), ("app/views.py", 17, "call", "post", "writer", None, None), ("app/views.py", 18, "call", "request_json", "local", "POST", None)]

REMOTE_SQL = "list_has_any(string_split(receiver, '.'), ['nc', 'ocs', '_session', 'session', 'adapter'])"


#: A syntax node for each event, of its own values.
EVENT_NODES = {
    "path": "CASE WHEN value < 40 THEN 'src/' || event_type || '/client.py' ELSE 'src\\\\' || event_type || '.py' END",
    "line": "cast(event_id AS INT)",
    "kind": "CASE WHEN user_id < 400 THEN 'import' WHEN user_id < 800 THEN 'identifier' ELSE 'call' END",
    "name": "CASE WHEN user_id < 100 THEN 'httpx' WHEN user_id < 200 THEN 'nc_py_api.' || event_type WHEN user_id < 400 THEN 'httpx_' || event_type WHEN user_id < 500 THEN 'upload' WHEN user_id < 600 THEN 'trash' WHEN user_id < 800 THEN event_type WHEN user_id < 1000 THEN 'ocs' WHEN user_id < 1200 THEN 'request' ELSE 'Post' END",
    "receiver": "CASE event_type WHEN 'view' THEN 'nc' WHEN 'click' THEN 'self._session' WHEN 'error' THEN 'index' ELSE event_type || '.adapter.x' END",
    "first": "CASE WHEN value < 30 THEN NULL WHEN value < 60 THEN 'put' WHEN value < 90 THEN 'GET' ELSE '/ok' END",
    "second": "CASE WHEN value < 45 THEN '/x' WHEN value < 75 THEN NULL ELSE '/ok' END",
}
_EVENT_NODES_SQL = ", ".join(f"{v.replace(chr(92) * 2, chr(92))} AS {c}" for c, v in EVENT_NODES.items())


@query(f"""WITH {values('fixed', ['path', 'line', 'kind', 'name', 'receiver', 'first', 'second'], NODES)}, raw AS (SELECT * FROM fixed UNION ALL SELECT {_EVENT_NODES_SQL} FROM events), n AS (SELECT * REPLACE (replace(path, '\\', '/') AS path), name IN ('ocs', 'request', 'request_json') AS entry FROM raw),
m AS (SELECT *, CASE WHEN entry THEN second ELSE first END AS target, CASE WHEN entry THEN CASE WHEN first IS NULL THEN CASE WHEN {REMOTE_SQL} THEN 'an unreadable method' END
    WHEN upper(first) IN ('PUT', 'POST', 'PATCH', 'DELETE') THEN upper(first) END
  WHEN upper(name) IN ('PUT', 'POST', 'PATCH', 'DELETE') AND {REMOTE_SQL} THEN upper(name) END AS verb FROM n WHERE kind = 'call')
SELECT path, line::INT AS line, 1::INT AS invariant, path || ':' || line || ': invariant 1, ' || name || ' may only be imported by client.py' AS message FROM n
  WHERE kind = 'import' AND path <> 'client.py' AND NOT ends_with(path, '/client.py') AND split_part(name, '.', 1) IN ('nc_py_api', 'httpx')
UNION ALL SELECT path, line::INT, 2::INT, path || ':' || line || ': invariant 2, writing identifier ' || name FROM n WHERE kind = 'identifier' AND name IN ('set_user', 'upload', 'upload_stream', 'delete', 'move', 'copy', 'mkdir', 'makedirs', 'trash')
UNION ALL SELECT path, line::INT, 3::INT, path || ':' || line || ': invariant 3, ' || verb || ' on ' || coalesce(target, 'an unknown path') FROM m WHERE verb IS NOT NULL AND coalesce(target, '') <> '/ok'""")
def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame(NODES, "path string, line int, kind string, name string, receiver string, first string, second string")
    n = n.unionByName(T.table(spark, sf_dir, "events").select(*[F.expr(v).alias(c) for c, v in EVENT_NODES.items()]))
    n = n.select("path", "line", "kind", "name", "receiver", F.array("first", "second").alias("positional"), F.create_map().cast("map<string,string>").alias("named"))
    return rules.violations(n, allowed=spark.createDataFrame([("/ok",)], "target string"))


#: A module for each document, by doc_id % 6: what it says, and what the rules find in it (line, invariant, text).
MODULES = [
    ("import json\n\nx = json.dumps('upload')\n", []),
    ("import os\nfrom httpx import get\n\nget('/a')\n", [(2, 1, "httpx may only be imported by client.py")]),
    ("def run(nc):\n    return nc.ocs('put', '/x')\n", [(2, 3, "PUT on /x")]),
    ("def run(nc, verb):\n    nc.session.request(verb, path='/y')\n    nc.ocs('GET', '/z')\n", [(2, 3, "an unreadable method on /y")]),
    ("class A:\n    def mkdir(self):\n        self._session.patch(url='/w')\n", [(2, 2, "writing identifier mkdir"), (3, 3, "PATCH on /w")]),
    ("not python (\n", []),
]
FOUND = [(k, *f) for k, (_, found) in enumerate(MODULES) for f in found]


@query(f"""WITH {values('f', ['k', 'line', 'invariant', 'what'], FOUND)}, m AS (SELECT doc_id % 6 AS k, lang || '/' || doc_id || '.py' AS path FROM documents)
SELECT path, list(path || ':' || line || ': invariant ' || invariant || ', ' || what ORDER BY line, invariant) AS messages FROM m JOIN f USING (k) GROUP BY path""")
def gate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over source files: each is parsed, and its violations are listed, files by path."""
    text = F.element_at(F.array(*[F.lit(m) for m, _ in MODULES]), (F.col("doc_id") % 6 + 1).cast("int"))
    sources = T.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("source"))
    return rules.as_list(rules.violations(files.python_nodes(sources)))


# Whole answers, and what goes out -----------------------------------------------------------------------------------

ANSWER_SQL = f"""h AS (SELECT source AS user_id, doc_id % 7 AS answer_id, doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id END AS file_id,
    CASE WHEN doc_id % 13 = 0 THEN 'dropped' WHEN doc_id % 11 = 0 THEN 'sentinel' ELSE 'ok' END AS verdict, {clean_sql('text', 1000)} AS snippet FROM documents),
folders AS (SELECT DISTINCT source AS user_id FROM documents WHERE source <> 'src1'), {T.NODES_SQL},
lost AS (SELECT DISTINCT user_id, answer_id FROM h WHERE verdict = 'ok' AND user_id NOT IN (SELECT user_id FROM folders)),
o AS (SELECT h.*, n.name, n.path AS node_path, CASE WHEN l.user_id IS NOT NULL THEN 'lost' WHEN verdict = 'dropped' THEN 'dropped' WHEN verdict = 'sentinel' THEN 'kept' WHEN n.file_id IS NULL THEN 'unresolved' WHEN h.pos % 17 = 0 THEN 'dropped' ELSE 'kept' END AS outcome
  FROM h LEFT JOIN lost l ON l.user_id = h.user_id AND l.answer_id = h.answer_id LEFT JOIN nodes n ON n.user_id = h.user_id AND n.file_id = h.file_id)"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's documents as seven answers. src1 has no home folder; every 13th hit is ill-shaped, every 11th the
    sentinel, and the name of every 17th node is no UTF-8."""
    d = T.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    verdict = F.when(i % 13 == 0, "dropped").when(i % 11 == 0, "sentinel").otherwise("ok")
    h = d.select(F.col("source").alias("user_id"), (i % 7).alias("answer_id"), i.alias("pos"), F.when(i % 11 == 0, 0).otherwise(i).cast("long").alias("file_id"), verdict.alias("verdict"), F.lit("reached").alias("title"), X.plain_text("text", X.MAX_SNIPPET).alias("snippet"))
    n = T.nodes(spark, sf_dir).withColumn("name", F.when(F.col("file_id") % 17 == 0, F.unhex(F.lit("C328")).cast("string")).otherwise(F.col("name")))
    return hits.recheck(h, n, d.where("source <> 'src1'").select(F.col("source").alias("user_id")).distinct())


@query(f"""WITH {ANSWER_SQL} SELECT user_id, answer_id, pos, outcome, file_id, CASE WHEN outcome <> 'kept' THEN '' WHEN verdict = 'ok' THEN {clean_sql("ltrim(node_path, '/')", 255)} ELSE '' END AS path,
  CASE WHEN outcome <> 'kept' THEN '' WHEN verdict = 'ok' THEN {clean_sql('name', 255)} ELSE 'reached' END AS title, snippet FROM o""")
def answer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filter of an answer, an answer that is lost with its user's home folder included. Title and path of what
    isn't kept show as ''."""
    a = answered(spark, sf_dir)
    shown = lambda c: F.when(F.col("outcome") == "kept", F.col(c)).otherwise("").alias(c)
    return a.select("user_id", "answer_id", "pos", "outcome", "file_id", shown("path"), shown("title"), "snippet")


@query(f"WITH {ANSWER_SQL} SELECT count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome = 'kept') AS kept FROM o")
def answer_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.drop_counts(answered(spark, sf_dir))


@query("""SELECT '{"results":[' || string_agg('{"fileId":' || n_nationkey || ',"path":"' || lower(n_name) || '","title":"' || n_name || '","snippet":"nation \\"' || n_nationkey || '\\""}', ',' ORDER BY n_name DESC) || ']}' AS body FROM nation""")
def answer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of an answer, in the answer's own order: here the names backwards."""
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.lower("n_name").alias("path"), F.col("n_name").alias("title"), F.concat(F.lit('nation "'), F.col("n_nationkey").cast("string"), F.lit('"')).alias("snippet"))
    return hits.envelope(n.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("title")))))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'signup' THEN 422 WHEN 'error' THEN 403 ELSE 500 END AS code FROM events)
SELECT event_id, code::INT AS code, CASE WHEN code >= 400 THEN '{"error":"no answer to \\"' || event_id || '\\""}' ELSE '' END AS body FROM c""")
def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that is no error has no error body; it shows as ''."""
    kind = F.col("event_type")
    code = F.when(kind == "view", 200).when(kind == "click", 404).when(kind == "signup", 422).when(kind == "error", 403).otherwise(500)
    e = T.table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.concat(F.lit('no answer to "'), F.col("event_id").cast("string"), F.lit('"')).alias("message"))
    return e.select("event_id", "code", F.coalesce(sinks.error_body("code", "message"), F.lit("")).alias("body"))


@query("SELECT page_id, NOT (contains(url, '<') OR contains(url, '>')) AS plain_url, NOT (contains(html, '<') OR contains(html, '>')) AS plain_html FROM pages")
def without_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", hits.without_markup("url").alias("plain_url"), hits.without_markup("html").alias("plain_html"))


@query(f"""WITH {STATUS_SQL} SELECT user_id, file_id, CASE WHEN status <> 'not-accessible' AND file_id % 5 = 0 THEN 'error' ELSE status END AS status,
  CASE WHEN file_id % 5 = 0 THEN 0 ELSE bytes_read END AS bytes_read,
  CASE WHEN status <> 'not-accessible' AND file_id % 5 = 0 THEN CASE WHEN file_id % 2 = 0 THEN 'ReadTimeout' ELSE 'ConnectError' END ELSE detail END AS detail
FROM results WHERE status <> 'not-accessible' OR file_id % 5 <> 0""")
def read_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth transfer breaks off, by a time limit or on the way."""
    f = T.files(spark, sf_dir).withColumn("failure", F.when((F.col("file_id") % 5 == 0) & (F.col("http_status") != 998), F.when(F.col("file_id") % 2 == 0, "ReadTimeout").otherwise("ConnectError")))
    return content.content_read(T.read_requests(spark, sf_dir), f).where("status <> 'not-accessible' OR file_id % 5 <> 0")


# Texts of files -----------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_full_match(text, '[\x{00}-\x{7F}\x{A0}-\x{FF}]*') THEN text || '€“œ”Ÿ' ELSE text END AS text FROM documents")
def encoding_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text that Latin-1 can write is stored in Windows-1252 with signs that only it has, the others as UTF-8: all
    are read back."""
    latin = F.col("text").rlike(r"^[\x{00}-\x{7F}\x{A0}-\x{FF}]*\z") & (F.col("doc_id") % 2 == 0)
    written = F.concat(F.encode("text", "ISO-8859-1"), F.lit(b"\x80\x93\x9c\x94\x9f"))
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.when(latin, written).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return d.select("doc_id", X.detected_text("content").alias("text"))


@query("SELECT 'document ' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 'skipped' ELSE 'read' END AS status, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS text FROM documents")
def office_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as word-processor documents, a paragraph a line. Every tenth is no such document; its text shows as ''."""
    d = _named(T.table(spark, sf_dir, "documents")).withColumn("broken", F.col("name").endswith("0"))
    return files.docx_text(files.as_docx(d)).select("name", "status", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'ü', 'u' || chr(776)), 'é', 'e' || chr(769))) AS text FROM documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose letters were taken apart are put together again."""
    apart = F.replace(F.replace("text", F.lit("ü"), F.lit("u\u0308")), F.lit("é"), F.lit("e\u0301"))
    return search.normalised(T.table(spark, sf_dir, "documents").select("doc_id", apart.alias("text")))


# Extensions ---------------------------------------------------------------------------------------------------------

TOKENS_SQL = "tokens AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS t FROM documents)"
TERMS = ["the", "idiot", "license"]


@query(f"WITH {TOKENS_SQL}, u AS (SELECT doc_id, unnest(t) AS term FROM tokens) SELECT term, doc_id, count(*) AS tf FROM u GROUP BY term, doc_id")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(T.table(spark, sf_dir, "documents"))


@query(f"""WITH {TOKENS_SQL}, u AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tokens), tf AS (SELECT doc_id, l, term, count(*) AS n FROM u WHERE term IN ('the', 'idiot', 'license') GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), s AS (SELECT count(*) AS c, avg(len(t)) AS a FROM tokens)
SELECT doc_id, round(sum(ln(1 + (c - d + 0.5) / (d + 0.5)) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / a)))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(T.table(spark, sf_dir, "documents"), TERMS)


@query("""WITH s AS (SELECT doc_id, string_split(lower(text), 'disgusting') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS k FROM s),
o AS (SELECT doc_id, i, k, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 10 AS s0 FROM u)
SELECT doc_id, s0::INT AS start, (s0 + 10)::INT AS "end" FROM o WHERE i < k""")
def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.highlights(T.table(spark, sf_dir, "documents"), "disgusting")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def status_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.by_hour(T.table(spark, sf_dir, "events"))


_indexes: dict = {}


def indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of documents, built once for an application and a folder of tables."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        _indexes[at] = index.Index(spark, shared_folder(spark, "index")).add(T.table(spark, sf_dir, "documents"))
    return _indexes[at]


@query(ORACLE_SQL["search_topk"])
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).top_k(TERMS)


PHRASES = ["licensed under the", "apache license version", "of the"]
POSITIONS_SQL = f"{TOKENS_SQL}, o AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tokens)"


@query(f"WITH {POSITIONS_SQL} " + " UNION ALL ".join(
    f"SELECT '{p}' AS phrase, o0.doc_id, o0.pos::INT AS start FROM " + " JOIN ".join((f"o o{i}" if i == 0 else f"o o{i} ON o{i}.doc_id = o0.doc_id AND o{i}.pos = o0.pos + {i}") for i in range(len(p.split()))) + " WHERE " + " AND ".join(f"o{i}.term = '{w}'" for i, w in enumerate(p.split()))
    for p in PHRASES))
def index_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three phrases stand, from positions alone."""
    ix = indexed(spark, sf_dir)
    found = [ix.phrase(p).select(F.lit(p).alias("phrase"), "doc_id", F.col("start").cast("int").alias("start")) for p in PHRASES]
    return found[0].unionByName(found[1]).unionByName(found[2])


WINDOW = ["the", "idiot"]


@query(f"""WITH {POSITIONS_SQL}, w AS (SELECT doc_id, pos, max(CASE WHEN term = 'the' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS a, max(CASE WHEN term = 'idiot' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM o WHERE term IN ('the', 'idiot')),
r AS (SELECT doc_id, least(a, b) AS s, pos + 1 AS e FROM w WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s, s) AS k FROM r)
SELECT doc_id, s::INT AS start, e::INT AS "end" FROM n WHERE k = 1""")
def index_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = indexed(spark, sf_dir).windows(WINDOW)
    return got.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A later batch: toxic documents come again with another text, and documents of low quality that aren't toxic go."""
    labels = T.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = T.table(spark, sf_dir, "documents").join(labels.where("toxic = 1"), "doc_id", "left_semi")
    return docs.select("doc_id", F.concat(F.lit("the license of an idiot. "), F.coalesce("text", F.lit(""))).alias("text")), labels.where("quality = 0 AND toxic = 0").select("doc_id")


@query(f"""WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
documents AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'the license of an idiot. ' || coalesce(d.text, '') ELSE d.text END AS text FROM main.documents d LEFT JOIN l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 0 AND l.toxic = 0, false)),
{ORACLE_SQL["search_topk"].removeprefix("WITH ")}""")
def index_updated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k after a batch of replacements and removals, over both generations folded into one."""
    new, gone = changes(spark, sf_dir)
    two = index.Index(spark, shared_folder(spark, "index")).add(T.table(spark, sf_dir, "documents")).add(new, gone)
    return two.merged(shared_folder(spark, "index")).top_k(TERMS)


@query("SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def corpus_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents written as files, read back after the commit; doc_id comes from the file's name."""
    docs = T.table(spark, sf_dir, "documents")
    named = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    at = corpus_sink.write(named, shared_folder(spark, "corpus"))
    got = corpus_sink.manifest(spark, at).withColumn("name", F.substring_index("path", "/", -1))
    return got.select(F.regexp_extract("name", r"^doc-(-?\d+)", 1).cast("long").alias("doc_id"), "name", "bytes", "sha256")


def kept_table(spark: SparkSession, name: str):
    """Writes a table in the shared folder and reads it again: what a round starts from."""

    def keep(df: DataFrame) -> DataFrame:
        at = shared_folder(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return keep


def folded_sql(c: str) -> str:
    for old, new in (*german.FOLDS, ("a' || chr(776) || '", "ae"), ("o' || chr(776) || '", "oe"), ("u' || chr(776) || '", "ue")):
        c = f"replace({c}, '{old}', '{new}')"
    return c


GERMAN_SQL = f"""t AS (SELECT doc_id, regexp_extract_all({folded_sql("lower(coalesce(text, ''))")}, '\\p{{L}}+') AS t FROM documents WHERE lang = 'de'),
w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL), c AS (SELECT term, sum(tf)::HUGEINT AS n FROM w GROUP BY term),
p AS (SELECT term, n FROM c WHERE n >= {german.MIN_COUNT} AND length(term) >= {german.MIN_PART}),
cuts AS (SELECT term, n, unnest(range({german.MIN_PART}, length(term) - {german.MIN_PART} + 1)) AS cut FROM c WHERE length(term) BETWEEN {2 * german.MIN_PART} AND {german.MAX_WORD}),
cand AS (SELECT term, n, cut, k, left(term, cut - k) AS first, substring(term, cut + 1) AS rest FROM cuts, (VALUES (0, ''), (1, 's'), (2, 'es')) l(k, x)
  WHERE ends_with(left(term, cut), x) AND cut - k >= {german.MIN_PART}),
ranked AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.term ORDER BY f.n * r.n DESC, cut, k) AS i
  FROM cand JOIN p f ON f.term = first JOIN p r ON r.term = rest WHERE f.n * r.n > cand.n * cand.n),
s AS (SELECT term AS word, first, rest FROM ranked WHERE i = 1)"""


@query(f"WITH {GERMAN_SQL} SELECT * FROM s")
def german_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compounds among the German documents' words, and where each is cut."""
    found = german.words(T.table(spark, sf_dir, "documents").where("lang = 'de'"))
    return german.splits(found.groupBy("term").agg(F.sum("tf").alias("n")))


@query(f"""WITH RECURSIVE {GERMAN_SQL}, r AS (SELECT word, unnest([first, rest]) AS part FROM s UNION ALL SELECT r.word, unnest([s.first, s.rest]) FROM r JOIN s ON r.part = s.word),
leaf AS (SELECT word, part FROM r WHERE part NOT IN (SELECT word FROM s))
SELECT doc_id, term, sum(tf)::BIGINT AS tf FROM (FROM w UNION ALL SELECT doc_id, part, tf FROM w JOIN leaf ON w.term = leaf.word) GROUP BY ALL""")
def german_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each German document: its folded words, and the parts of its compounds."""
    return german.terms(T.table(spark, sf_dir, "documents").where("lang = 'de'"), kept_table(spark, "german"))


#: A document's folder: mostly the one of half its number, or the document before it; some are roots, some are below one that
#: is missing, and some below one another.
_PARENT = "CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 89 = 1 THEN -doc_id WHEN doc_id % 101 = 5 THEN doc_id + 1 WHEN doc_id % 101 = 6 THEN doc_id - 1 WHEN doc_id % 3 = 0 THEN doc_id - 1 ELSE {half} END"


@query(f"""WITH RECURSIVE n AS (SELECT doc_id AS id, {_PARENT.format(half='doc_id // 2')} AS parent, lang || doc_id AS name FROM documents),
ok AS (SELECT id, '/' || name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, ok.path || '/' || n.name FROM n JOIN ok ON n.parent = ok.id),
lost AS (SELECT id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id FROM n JOIN lost ON n.parent = lost.id)
SELECT id, coalesce(path, '') AS path, CASE WHEN path IS NOT NULL THEN 'ok' WHEN id IN (FROM lost) THEN 'orphan' ELSE 'cycle' END AS status FROM n LEFT JOIN ok USING (id)""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from nodes that know their parent only; what has no path shows as ''."""
    d = T.table(spark, sf_dir, "documents")
    n = d.select(F.col("doc_id").alias("id"), F.expr(_PARENT.format(half="doc_id div 2")).alias("parent"), F.concat("lang", F.col("doc_id").cast("string")).alias("name"))
    return tree.paths(n, kept_table(spark, "paths")).select("id", F.coalesce("path", F.lit("")).alias("path"), "status")


#: A name of the manifests with folders, by its number: twenty files a folder.
_IN_FOLDERS = "concat(split_part(name, ' ', 1), '/', {int}(split_part(name, ' ', 2) AS BIGINT) {div} 400, '/', {int}(split_part(name, ' ', 2) AS BIGINT) {div} 20, '/', name)"
_SQL_NAME, _SPARK_NAME = _IN_FOLDERS.format(int="CAST", div="//"), _IN_FOLDERS.format(int="CAST", div="div")


@query(f"WITH {CHANGED_SQL} SELECT {_SQL_NAME} AS name, change FROM d WHERE change <> 'same'")
def folder_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots, found from the root down by the digests of folders."""
    two = [tree.Snapshot(spark, shared_folder(spark, "snapshot")).write(m.withColumn("name", F.expr(_SPARK_NAME))) for m in _changed(spark, sf_dir)]
    return tree.diff(*two, kept_table(spark, "folders"))


@query(f"""WITH {ANSWER_SQL} SELECT count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'unresolved') AS unresolved,
  count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'kept') AS written FROM o""")
def answer_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's kept hits are written, and the same job counts what was dropped; written counts the table's rows."""
    rows, seen = hits.counted(answered(spark, sf_dir))
    at = shared_folder(spark, "answer")
    rows.where("outcome = 'kept'").write.parquet(at)
    counts = seen.get
    return spark.read.schema(rows.schema).parquet(at).agg(*[F.lit(counts[c]).cast("long").alias(c) for c in ("dropped", "unresolved", "kept")], F.count("*").alias("written"))


@query(f"""WITH {CHANGED_SQL}, w AS (SELECT d.name, change AS task, coalesce(a.bytes::VARCHAR, 'gone') AS value, split_part(d.name, ' ', 2)::BIGINT AS n, starts_with(d.name, 'page') AS page
  FROM d LEFT JOIN after a ON a.name = d.name WHERE change <> 'same')
SELECT name, CASE WHEN page AND n % 10 = 0 THEN 3 WHEN page AND n % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS batch, CASE WHEN page AND n % 5 = 0 THEN 'again' ELSE task END AS task,
  CASE WHEN page AND n % 10 = 0 THEN 'ready' WHEN page AND n % 5 = 0 THEN 'leased' WHEN n % 11 = 5 THEN 'dead' ELSE 'done' END AS state,
  CASE WHEN page AND n % 10 = 0 THEN 0 WHEN page AND n % 5 = 0 THEN 1 WHEN n % 11 = 5 THEN 2 WHEN n % 7 = 3 OR n % 13 = 4 THEN 2 ELSE 1 END::INT AS attempts,
  CASE WHEN (page AND n % 5 = 0) OR n % 11 = 5 THEN '' ELSE value END AS value FROM w""")
def queue_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a corpus as a work list. Two workers with a half each go over it twice; the work is to look up a
    file's size. Some items always fail, some at first, and some workers are lost with theirs. Then some pages come again and
    are taken, and some of those come once more."""
    before, after = _changed(spark, sf_dir)
    q = queue.Queue(spark, shared_folder(spark, "queue"), shards=4, attempts=2)
    q.add(manifest.diff(before, after).where("change <> 'same'").select("name", F.col("change").alias("task")), 1)
    n = F.split_part("name", F.lit(" "), F.lit(2)).cast("long")
    for now in (0, 1000):
        for k in range(2):
            mine = q.claim(f"{now}-{k}", now, 600, k, 2).where((n % 13 != 4) | (F.col("attempt") > 1))
            sizes = mine.join(after.select("name", "bytes"), "name", "left")
            ok = (n % 11 != 5) & ((n % 7 != 3) | (F.col("attempt") > 1))
            q.complete(f"{now}-{k}", sizes.select("name", ok.alias("ok"), F.coalesce(F.col("bytes").cast("string"), F.lit("gone")).alias("value")), now + 100)
    pages = T.table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), F.lit("again").alias("task"))
    q.add(pages.where(n % 5 == 0), 2).claim("again", 3000, 600)
    q.add(pages.where(n % 10 == 0), 3)
    return q.state(3100).select("name", "batch", "task", "state", "attempts", F.coalesce("value", F.lit("")).alias("value"))
