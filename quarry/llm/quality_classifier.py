"""Quality classifier by hierarchical empirical Bayes.

Two sources of evidence are combined: what a classifier says of a document's own text, and what labels say of the site it
comes from.

1. Each whole text becomes a few numbers (FEATURES); a logistic regression is fitted on the driver to the labelled ones,
   at most MAX_LABELLED of them (those with the smallest hash of the key): a bounded sample of bounded rows.
2. Labels are counted by path and by host with grouped, map-side combined sums. Beta priors tie the levels: a host's share
   of good documents is shrunk toward the global share and a path's toward its host's, each with a prior strength estimated
   by moments over all hosts (paths) with labels, so a site with few labels stays near its parent, and one without any is at
   it.
3. A document's score is the posterior of its classifier's likelihood ratio under its path's prior, from which its own label,
   if it has one, is taken out.

Documents carry no URL, so their site is `source` and their path below it is `lang`; both are parameters. Only counts are
shared between levels: a source with a third of all rows is one row after map-side combination.

Defined results: null and empty texts have the features of a text without words; null hosts and paths are groups of their
own; labels that are null, of unknown documents, or of an id whose labels disagree count for nothing, equal ones of one id
count once for each row of that id; without labels of both kinds the classifier says the smoothed share of good ones;
repeated rows count each; documents of equal hash at the sample's edge are taken in order of their features, so reruns
agree; an empty table gives no rows. A very long text is read once, whole, into its numbers (its words take about ten times
its size meanwhile). Only the named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialise, sized, table, unit_hash

MAX_LABELLED = 20_000
KEEP = 0.5
PENALTY = 1e-3
#: Probabilities and priors stay this far from 0 and 1.
EDGE = 1e-3
FEATURES = ("log_words", "word_length", "symbols", "digits", "capitals", "exclamations", "bars", "distinct_words", "distinct_pairs", "log_line_words", "sentence_ends")


def text_features(text: str | None) -> list[float]:
    text = text or ""
    words, size = text.split(), max(len(text), 1)
    n = len(words)
    chars = sum(map(len, words))
    pairs = max(n - 1, 1)
    return [
        math.log1p(n), min(chars / max(n, 1), 40.0),
        min(sum(map(text.count, "#*$%&<>")) / size * 20, 3.0), min(sum(map(text.count, "0123456789")) / size * 10, 3.0),
        sum(w.isupper() and len(w) > 1 for w in words) / max(n, 1), min(text.count("!") / max(n, 1), 3.0), min(text.count("|") / max(n, 1), 3.0),
        len(set(words)) / max(n, 1), len(set(zip(words, words[1:]))) / pairs if n > 1 else 1.0,
        math.log1p(n / (text.count("\n") + 1)), min(sum(map(text.count, ".?")) / max(n, 1), 1.0),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights of the raw features, bias, share of good labels) by Newton steps on standardised features."""
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(len(FEATURES))
    if len(set(y.tolist())) < 2:
        return w, math.log(share / (1 - share)), share
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    ridge = np.diag([PENALTY * len(y)] * len(w) + [1e-9])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / sd, float(b[-1] - (b[:-1] * mean / sd).sum()), share


def strength(groups: DataFrame) -> float:
    """The Beta prior's strength by moments over groups(n, good, parent): spread of group shares around their parents' beyond
    what chance would give. One row comes to the driver."""
    m = F.col("good") / F.col("n")
    r = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(m - F.col("parent"), 2)).alias("s"), F.sum(F.col("parent") * (1 - F.col("parent"))).alias("v"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    return strength_of(r["s"], r["v"], r["n"], r["k"])


def strength_of(s, v, n, k) -> float:
    if not k or not v:
        return 10.0
    between = max((s - v) / max(n - k, 1), 1e-6)
    return float(min(max(v / k / between - 1, 1.0), 1e4))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """key, host, path, p_doc, host_posterior, path_posterior, score, kept of every row of docs."""
    kinds = dict(docs.dtypes)
    make = lambda: lambda b: {"k": b["k"], "host": b["host"], "path": b["path"]} | {n: list(c) for n, c in zip(FEATURES, [*zip(*map(text_features, b["t"]))] or [()] * len(FEATURES))}
    rows = docs.select(F.col(key).alias("k"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("t"))
    rows = materialise(map_batches(rows, make, f"k {kinds[key]}, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES)), "quality-features")
    said = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("z")).where("y = z").select("k", "y")
    said = sized(materialise(said, "quality-labels"))  # its size is then known: small ones are broadcast
    known = materialise(rows.join(said, "k").select("host", "path", *FEATURES, "y", unit_hash("k").alias("h")), "quality-labelled")
    bar = int((1 << 60) * min(1.0, 0.95 * MAX_LABELLED / max(known.count(), 1)))  # the share with the smallest hash
    sample = known.where(F.col("h") <= bar).orderBy("h", *FEATURES, "y").select(*FEATURES, "y").limit(MAX_LABELLED).collect()
    data = np.array([list(r) for r in sample], float).reshape(-1, len(FEATURES) + 1)
    w, bias, share = fit(data[:, :-1], data[:, -1])
    z = F.lit(bias)
    for name, weight in zip(FEATURES, w):
        z = z + F.col(name) * F.lit(float(weight))
    p = F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(EDGE)), F.lit(1 - EDGE))
    paths = materialise(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")).first()
    mean = (total["good"] + 1) / (total["n"] + 2)
    a = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(mean).alias("parent")))
    hosts = materialise(hosts.withColumn("host_posterior", (F.lit(a * mean) + F.col("host_good")) / (F.lit(a) + F.col("host_n"))), "quality-hosts")
    b = strength(paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select("n", "good", F.col("host_posterior").alias("parent")))
    # One row a host or path with labels; their sizes are known to the planner from here.
    rows = rows.join(said, "k", "left").select("k", "host", "path", p.alias("p_doc"), "y").alias("d")
    joined = rows.join(sized(hosts).alias("h"), F.expr("d.host <=> h.host"), "left").join(sized(paths).alias("p"), F.expr("d.host <=> p.host AND d.path <=> p.path"), "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    joined = joined.select("d.*", count("host_n").alias("host_n"), count("host_good").alias("host_good"), count("n").alias("n"), count("good").alias("good"))
    own = F.col("y").isNotNull().cast("int")
    y = F.coalesce("y", F.lit(0.0))
    host_posterior = (F.lit(a * mean) + F.col("host_good")) / (F.lit(a) + F.col("host_n"))
    path_posterior = (F.lit(b) * host_posterior + F.col("good")) / (F.lit(b) + F.col("n"))
    # The prior of a document comes from the labels of others.
    host_prior = (F.lit(a * mean) + F.col("host_good") - y) / (F.lit(a) + F.col("host_n") - own)
    prior = F.least(F.greatest((F.lit(b) * host_prior + F.col("good") - y) / (F.lit(b) + F.col("n") - own), F.lit(EDGE)), F.lit(1 - EDGE))
    odds = F.col("p_doc") / (1 - F.col("p_doc")) / F.lit(share / (1 - share)) * prior / (1 - prior)
    return joined.select(F.col("k").alias(key), "host", "path", "p_doc", host_posterior.alias("host_posterior"), path_posterior.alias("path_posterior"), (odds / (1 + odds)).alias("score"), (odds / (1 + odds) >= KEEP).alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
