"""A leased work list over written snapshots (an extension).

Three logs below a root, each with the item's name, a shard (a hash range of the name, and a folder) and a batch: what is to be
done, who took it until when, and what came of it. Nothing is ever changed in place; an item's state follows from its rows:

    ready     never taken, or its last lease ran out or failed, with attempts left
    leased    taken, not answered, and the lease still runs
    done      an attempt succeeded; the first one's value counts, whatever came in later
    dead      all attempts were used up

Only the newest batch of a name counts, so that a file that changed twice is worked on once. A claim takes the ready items of
its range of shards: workers with ranges of their own never meet. If two take one range at once both do the work, but their
answers count once. An answer counts only with a lease, also one that has run out. Repeating add() with a batch, or complete()
with a claim, replaces what it wrote before; repeating claim() gives what that claim took at first. Times are given, in seconds, so a rerun decides alike.

Names are not null; an empty batch, claim or answer is fine. Of several rows of one name in a batch the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "name string, batch long, task string"
LEASES = "name string, batch long, claim string, attempt int, at long, until long, task string"
RESULTS = "name string, batch long, claim string, attempt int, at long, ok boolean, value string"


class Queue:
    def __init__(self, spark: SparkSession, root: str, shards: int = 64, attempts: int = 3):
        self.spark, self.root, self.shards, self.attempts = spark, root.rstrip("/"), shards, attempts
        for log, schema in (("items", ITEMS), ("leases", LEASES), ("results", RESULTS)):
            spark.createDataFrame([], f"{schema}, shard int").write.mode("ignore").partitionBy("shard").parquet(f"{self.root}/{log}/part=none")

    def _write(self, df: DataFrame, log: str, part: str, mode: str = "overwrite") -> None:
        shard = F.pmod(F.xxhash64("name"), F.lit(self.shards)).cast("int")
        df.withColumn("shard", shard).repartition("shard").write.mode(mode).partitionBy("shard").parquet(f"{self.root}/{log}/part={part}")

    def _read(self, log: str, schema: str, lo: int, hi: int) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, part string, shard int").option("basePath", f"{self.root}/{log}").parquet(f"{self.root}/{log}/part=*")
        return rows.where(F.col("shard").between(lo, hi - 1)).drop("part")

    def add(self, work: DataFrame, batch: int) -> "Queue":
        """work(name, task): what to do, for example the rows of a manifest's diff that changed."""
        rows = work.groupBy("name").agg(F.min("task").alias("task")).select("name", F.lit(batch).cast("long").alias("batch"), "task")
        self._write(rows, "items", f"{batch:012d}")
        return self

    def state(self, now: int, lo: int = 0, hi: int | None = None) -> DataFrame:
        """name, batch, task, state, attempts, value of the newest batch of each name. One shuffle: the rows of all three
        logs are dealt by name, which both groupings use. An item has a few rows only."""
        hi = self.shards if hi is None else hi
        null = lambda c, t: F.lit(None).cast(t).alias(c)
        columns = [("task", "string"), ("claim", "string"), ("attempt", "int"), ("at", "long"), ("until", "long"), ("ok", "boolean"), ("value", "string")]
        log = None
        for kind, schema in (("items", ITEMS), ("leases", LEASES), ("results", RESULTS)):
            has = {c.split()[0] for c in schema.split(", ")}
            rows = self._read(kind, schema, lo, hi).select(F.lit(kind).alias("kind"), "name", "batch", *[F.col(c) if c in has else null(c, t) for c, t in columns])
            log = rows if log is None else log.unionAll(rows)
        of = lambda k: F.col("kind") == k
        won = of("results") & F.col("ok")
        each = log.repartition("name").groupBy("name", "batch").agg(
            F.min(F.when(of("items"), F.col("task"))).alias("task"),
            F.coalesce(F.max(F.when(of("leases"), F.col("attempt"))), F.lit(0)).alias("attempts"),
            F.min(F.when(won, F.struct("attempt", "claim", "value"))).alias("won"),
            F.max(F.when(of("leases"), F.struct("attempt", "until"))).alias("last"),
            F.coalesce(F.max(F.when(of("results"), F.col("attempt"))), F.lit(0)).alias("answered"),
        )
        newest = each.groupBy("name").agg(F.max_by(F.struct("batch", "task", "attempts", "won", "last", "answered"), "batch").alias("s")).select("name", "s.*")
        runs = (F.col("last.until") > now) & (F.col("answered") < F.col("attempts"))
        state = F.when(F.col("won").isNotNull(), "done").when(runs, "leased").when(F.col("attempts") >= self.attempts, "dead").otherwise("ready")
        return newest.select("name", "batch", "task", state.alias("state"), "attempts", F.col("won.value").alias("value"))

    def claim(self, claim: str, now: int, seconds: int, worker: int = 0, of: int = 1) -> DataFrame:
        """name, batch, task, attempt of what this claim took: the ready items of range `worker` of `of`. The lease is
        written first and read back, so what is worked on is what was taken."""
        lo, hi = worker * self.shards // of, (worker + 1) * self.shards // of
        took = self.state(now, lo, hi).where("state = 'ready'")
        rows = took.select("name", "batch", F.lit(claim).alias("claim"), (F.col("attempts") + 1).alias("attempt"), F.lit(now).cast("long").alias("at"), F.lit(now + seconds).cast("long").alias("until"), "task")
        self._write(rows, "leases", claim, "ignore")
        return self.leases(claim, lo, hi).select("name", "batch", "task", "attempt")

    def leases(self, claim: str, lo: int = 0, hi: int | None = None) -> DataFrame:
        return self._read("leases", LEASES, lo, self.shards if hi is None else hi).where(F.col("claim") == claim)

    def complete(self, claim: str, answers: DataFrame, now: int) -> None:
        """answers(name, ok, value): what came of items of the claim; others are left out, and so are repeats (one that
        succeeded goes first). Items without an answer stay leased until the lease runs out."""
        best = answers.groupBy("name").agg(F.max("ok").alias("ok"), F.min(F.when(F.col("ok"), F.col("value"))).alias("value"))
        rows = self.leases(claim).join(best, "name")
        self._write(rows.select("name", "batch", "claim", "attempt", F.lit(now).cast("long").alias("at"), "ok", "value"), "results", claim)

    def compacted(self, root: str, now: int) -> "Queue":
        """The queue as a new one, one part a log, without what newer batches replaced. What is done stays known."""
        new = Queue(self.spark, root, self.shards, self.attempts)
        live = self.state(now).select("name", "batch")
        everything = lambda log, schema: self._read(log, schema, 0, self.shards).drop("shard").join(live, ["name", "batch"], "left_semi")
        for log, schema in (("items", ITEMS), ("leases", LEASES), ("results", RESULTS)):
            new._write(everything(log, schema), log, "compacted")
        return new
