from pyspark.sql import functions as F

from quarry.operators import queue
from quarry.session import shared_folder


def states(q, now):
    return {r.name: (r.state, r.attempts, r.value) for r in q.state(now).collect()}


def work(spark, *names, task="t"):
    return spark.createDataFrame([(n, task) for n in names], "name string, task string")


def done(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, ok boolean, value string")


def make(spark):
    return queue.Queue(spark, shared_folder(spark, "queue"), shards=4, attempts=2)


def test_each_item_is_taken_once(spark):
    q = make(spark).add(work(spark, *[f"f{k}" for k in range(40)]), 1)
    took = [r.name for k in range(3) for r in q.claim(f"c{k}", 0, 100, k, 3).collect()]
    assert sorted(took) == sorted(f"f{k}" for k in range(40))
    assert q.claim("c0", 50, 100, 0, 3).count() == len([r for r in q.leases("c0").collect()]) > 0  # the same claim again
    assert q.claim("more", 50, 100).count() == 0  # a second run over the same snapshot
    for k in range(3):
        q.complete(f"c{k}", q.leases(f"c{k}").select("name", F.lit(True).alias("ok"), F.upper("name").alias("value")), 60)
    assert states(q, 500) == {f"f{k}": ("done", 1, f"F{k}") for k in range(40)}
    assert q.claim("late", 500, 100).count() == 0


def test_lost_workers_failures_and_repeats(spark):
    q = make(spark).add(work(spark, "a", "b", "c", "d", "a"), 1)
    q.claim("1", 0, 100)
    answers = done(spark, ("a", True, "x"), ("a", False, None), ("a", True, "w"), ("b", False, None), ("nobody", True, "y"))
    q.complete("1", answers, 10)
    q.complete("1", answers, 10)
    assert states(q, 20) == {"a": ("done", 1, "w"), "b": ("ready", 1, None), "c": ("leased", 1, None), "d": ("leased", 1, None)}
    assert {r.name: r.attempt for r in q.claim("2", 20, 100).collect()} == {"b": 2}
    q.complete("2", done(spark, ("b", False, None), ("c", True, "not its own")), 30)
    assert states(q, 99)["b"] == ("dead", 2, None) and states(q, 100)["c"] == ("ready", 1, None)
    assert {r.name: r.attempt for r in q.claim("3", 100, 100).collect()} == {"c": 2, "d": 2}
    q.complete("3", done(spark, ("c", True, "second")), 110)
    q.complete("1", done(spark, ("c", True, "first, but late"), ("a", True, "w")), 120)  # an expired lease's answer counts
    assert states(q, 130)["c"] == ("done", 2, "first, but late") and states(q, 130)["d"][0] == "leased" and states(q, 201)["d"] == ("dead", 2, None)
    assert q.claim("4", 300, 100).count() == 0


def test_newer_batches_replace_older(spark):
    q = make(spark).add(work(spark, "a", "b"), 1)
    q.claim("1", 0, 100)
    q.add(work(spark, "a", task="new"), 2)
    q.add(work(spark, "a", task="new"), 2)
    q.complete("1", done(spark, ("a", True, "old"), ("b", True, "kept")), 10)
    assert states(q, 20) == {"a": ("ready", 0, None), "b": ("done", 1, "kept")}
    c = q.compacted(shared_folder(spark, "queue"), 20)
    assert states(c, 20) == states(q, 20) and c._read("results", queue.RESULTS, 0, 4).count() == 1
    assert [(r.name, r.task, r.attempt) for r in c.claim("2", 30, 100).collect()] == [("a", "new", 1)]


def test_one_shuffle_and_own_folders_only(spark):
    q = make(spark).add(work(spark, *[f"f{k}" for k in range(40)]), 1)
    q.claim("1", 0, 100)
    plan = q.state(0, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "PartitionFilters: [isnotnull(shard" in plan


def test_empty(spark):
    q = make(spark)
    assert q.state(0).count() == 0 and q.claim("1", 0, 10).count() == 0
    q.complete("1", done(spark), 5)
    assert q.add(work(spark), 1).state(0).count() == 0
