"""Read-only rules over a table of syntax nodes.

nodes(path, line, kind, name, receiver, positional, named): kind is import, identifier or call. For an import name is the
module; for a call name is the attribute that is called, receiver the dotted path it is called on, and positional and named
hold its arguments as far as they are literal strings. quarry.sources.files.python_nodes makes such a table of source files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIENT = "client.py"
#: Import roots only the client may name, and identifiers nobody may.
RESTRICTED = ("nc_py_api", "httpx")
FORBIDDEN = ("set_user", "upload", "upload_stream", "delete", "move", "copy", "mkdir", "makedirs", "trash")
#: HTTP methods that write, calls that take a method, and receivers outside the process.
WRITING = ("PUT", "POST", "PATCH", "DELETE")
ENTRY_POINTS = ("ocs", "request", "request_json")
REMOTE = ("nc", "ocs", "_session", "session", "adapter")


def violations(nodes: DataFrame, client: str = CLIENT, allowed: DataFrame | None = None) -> DataFrame:
    """path, line, invariant, message. A node may break several rules; allowed(target) may be written to."""
    n = nodes.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    in_client = (F.col("path") == client) | F.col("path").endswith("/" + client)
    at = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": invariant "))
    rule = lambda rows, k, text: rows.select("path", "line", F.lit(k).alias("invariant"), F.concat(at, F.lit(f"{k}, "), text).alias("message"))
    imports = n.where((F.col("kind") == "import") & ~in_client & F.split_part("name", F.lit("."), F.lit(1)).isin(*RESTRICTED))
    names = n.where((F.col("kind") == "identifier") & F.col("name").isin(*FORBIDDEN))
    entry = F.col("name").isin(*ENTRY_POINTS)
    argument = lambda at, *names: F.coalesce(F.get("positional", at), *(F.try_element_at("named", F.lit(k)) for k in names))
    remote = F.arrays_overlap(F.split("receiver", r"\."), F.array(*map(F.lit, REMOTE)))
    verb = F.upper(argument(0, "method"))
    method = (F.when(entry, F.when(verb.isNull(), F.when(remote, "an unreadable method")).when(verb.isin(*WRITING), verb))
              .when(F.upper("name").isin(*WRITING) & remote, F.upper("name")))
    target = F.when(entry, argument(1, "path", "url", "path_and_query")).otherwise(argument(0, "path", "url"))
    calls = n.where(F.col("kind") == "call").withColumn("_verb", method).where("_verb IS NOT NULL").withColumn("target", target)
    if allowed is not None:
        calls = calls.join(allowed.select("target"), "target", "left_anti")
    return (rule(imports, 1, F.concat("name", F.lit(" may only be imported by "), F.lit(client)))
            .unionByName(rule(names, 2, F.concat(F.lit("writing identifier "), "name")))
            .unionByName(rule(calls, 3, F.concat("_verb", F.lit(" on "), F.coalesce("target", F.lit("an unknown path"))))))


def as_list(found: DataFrame) -> DataFrame:
    """path, messages: a file's violations in order, files by path."""
    return found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "invariant", "message"))), lambda x: x["message"]).alias("messages")).orderBy("path")
