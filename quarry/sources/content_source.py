"""Files behind an HTTP gateway as a data source, read as one user.

    spark.dataSource.register(ContentSource)
    spark.read.format("content").option("base", url).option("user", u).option("ids", "4 8-20").load()

A row for each id, in partitions of `batch` ids: what the gateway answered (http_status), how many bytes came (n_bytes), their
sha256, and why a transfer broke off (failure), in the shape that quarry.operators.content.content_read takes. With the option
blocks a row is a block: block_no, running_bytes and block. Bodies pass in blocks of at most BLOCK bytes and are never held
whole; redirects are not followed. A row never fails the job: `timeout` seconds for each file as a whole, and `most` bytes, end
its transfer with a failure, as do broken connections.

ids are single ids and ranges, or the name of a folder of tables written with write_ids() in the option ids_from, whose files
are the partitions, so that a list of any length stays on the executors. That folder must be one that Python can open there.
"""

from __future__ import annotations

import hashlib
import http.client
import os
import time
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 65_536
STATUS = "user_id string, file_id long, http_status int, n_bytes long, sha256 string, failure string"
BLOCKS = "user_id string, file_id long, block_no int, running_bytes long, block binary"


def parse_ids(text: str) -> list[range]:
    """`4 8-20` as ranges; a range keeps its ends and is never spelt out."""
    out = []
    for word in text.replace(",", " ").split():
        lo, _, hi = word.partition("-")
        if not (lo.isascii() and lo.isdigit() and (not hi or hi.isascii() and hi.isdigit())) or word.endswith("-"):
            raise ValueError(f"{word!r} is no id and no range of ids")
        out.append(range(int(lo), int(hi or lo) + 1))
    return out


def write_ids(df: DataFrame, folder: str, key: str = "file_id") -> None:
    df.select(F.col(key).cast("string")).write.mode("overwrite").text(f"file://{folder}")


def transfer(base: str, route: str, user: str, file_id: int, headers: dict, timeout: float, most: int):
    """(http_status, block) as they come; the first has no block. Raises what breaks the transfer off."""
    end = time.monotonic() + timeout
    u = urlsplit(base)
    kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
    c = kind(u.netloc, timeout=timeout)
    try:
        c.request("GET", f"{u.path.rstrip('/')}{route}{file_id}", headers={**headers, "X-User-Id": user})
        r = c.getresponse()
        yield r.status, None
        n = 0
        if r.status < 400:
            while True:
                left = end - time.monotonic()
                if left <= 0:
                    raise TimeoutError
                if c.sock is not None:
                    c.sock.settimeout(left)
                block = r.read1(BLOCK)
                if not block:
                    if r.length:
                        raise http.client.IncompleteRead(b"", r.length)
                    return
                n += len(block)
                if n > most:
                    raise OverflowError
                yield r.status, block
    finally:
        c.close()


class _Ids(InputPartition):
    def __init__(self, ids: range | None, path: str | None = None):
        self.ids, self.path = ids, path


class ContentReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.base, self.user, self.route = options["base"], options["user"], get("route", "/content/")
        self.timeout, self.most, self.batch = float(get("timeout", 90)), int(get("most", 1 << 62)), max(1, int(get("batch", 64)))
        self.headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
        self.blocks, self.ids, self.ids_from = get("blocks", "false").lower() == "true", get("ids", ""), get("ids_from")

    def partitions(self):
        if self.ids_from:
            return [_Ids(None, os.path.join(self.ids_from, n)) for n in sorted(os.listdir(self.ids_from)) if n.startswith("part-")] or [_Ids(range(0))]
        return [_Ids(r[lo : lo + self.batch]) for r in parse_ids(self.ids) for lo in range(0, len(r), self.batch)] or [_Ids(range(0))]

    def read(self, partition):
        if partition.path:
            with open(partition.path) as f:
                yield from (row for line in f for row in self.rows(int(line)))
        else:
            yield from (row for i in partition.ids for row in self.rows(i))

    def rows(self, file_id: int):
        status, n, k, digest, failure = None, 0, 0, hashlib.sha256(), None
        try:
            for status, block in transfer(self.base, self.route, self.user, file_id, self.headers, self.timeout, self.most):
                for lo in range(0, len(block or b""), BLOCK):
                    part = block[lo : lo + BLOCK]
                    n += len(part)
                    digest.update(part)
                    if self.blocks:
                        yield self.user, file_id, k, n, part
                    k += 1
        except (OSError, http.client.HTTPException, OverflowError) as e:
            failure = type(e).__name__
        if not self.blocks:
            yield self.user, file_id, status, n, digest.hexdigest() if failure is None and status is not None and status < 400 else None, failure


class ContentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "content"

    def schema(self) -> str:
        return BLOCKS if self.options.get("blocks", "false").lower() == "true" else STATUS

    def reader(self, schema) -> ContentReader:
        return ContentReader(dict(self.options))
