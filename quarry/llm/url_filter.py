"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The labelled table is a list of hosts and paths below: names of ordinary sites, more of them than of the kinds that a corpus
should not take, each with a few fronts, endings and paths by rule, and the url that says nothing. The model is fitted to it
by full-batch gradient descent on the driver (a fixed table, so a fixed cost) and shipped as BUCKETS floats. Scoring hashes
the n-grams of a slice of URLs in one flat byte array; a very long url is as many bytes more, and its n-grams' weights are
scaled by the root of their number, so it is never cut.

Defined results: a null url or one without "://" has an empty host and path and fits no rule; the model sees no n-gram and
its fitted bias decides. Hosts compare with A-Z lower-cased. Of equally long rules that fit, the one whose host is longer
wins (the same host and path can't be listed twice). Repeated urls get equal verdicts, rows of one id are judged each for
itself; an empty table gives no rows; of the table only key and url are read, so names of other columns don't matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, table

#: (host, path prefix, verdict). A rule fits its host and all subdomains; the longest host + path that fits wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: n-grams of these lengths, of "^host$" and "^path$" apart.
LENGTHS = (3, 4, 5)
BUCKETS = 1 << 16
STEPS, RATE, PENALTY = 2000, 4.0, 1e-5

#: Names of sites that a corpus should not take: gambling, pills, adult, advertising, spam, pirated copies, loans.
BAD = """casino-royal best-casino grandcasino onlinecasino casinos24 bet-now sports-bets mybets betting-tips poker-stars slots-bonus
jackpot-city win-lottery roulette-live pills-online diet-pills pillstore viagra-shop rx-pharmacy discount-meds adult-cams
adultdating adults-only xxx-videos sex-chat porn-tube hot-girls adserver click-ads banner-ads popads ads-network
track-click tracking-pixel mailtracker spammers spam-king spam-seo link-farms content-farm seo-links buy-followers replica-bags
free-iphone free-prizes win-prizes get-rich fast-cash payday-loans easy-loans crypto-double cheap-replica cheapmeds warez-crack
free-torrents keygen-serial crack-download""".split()
#: Names of ordinary sites, in several languages.
GOOD = """river-museum city-library open-archive weather history gardening cooking-notes mountain-club school-north
university physics-review town-council daily-herald the-chronicle morning-post science-today birdwatch railways
theatre orchestra translation linguistics bookshop hospital nature-trust harbour village-news football-club chess
astronomy geology maths-forum programming-blog writings letters reader journal travel-diary photography
artisan bakery carpentry ceramics stadtarchiv volkshochschule feuerwehr sternwarte wanderverein buchhandlung tageszeitung
gemeinde bibliothek mairie lycee patrimoine recettes jardinage randonnee quotidien ayuntamiento biblioteca recetas
senderismo universidad periodico opinion education nation-review thursday-club mathematics earth-sciences foundation
research-institute international parliament statistics standards transport meteorology oceanography health-advice
together father-and-son northern-lights whether ethics-lab thread-and-needle winter-sports advent-choir address-book
shadow-theatre farmers-market wine-tasting freedom-press trackside-cafe windmill betsy-ross roads bread""".split()
GOOD_PATHS = ("/en/12", "/de/articles/4", "/fr/2019/05/note.html", "/", "/es/about", "/wiki/History", "/en/731/", "/page-9.html")
BAD_PATHS = ("/en/12", "/de/bonus/4", "/fr/win/now.html", "/", "/es/promo", "/click", "/en/731/", "/page-9.html")
ENDINGS = ("example.com", "example.net", "example.org", "co.uk", "info")
FRONTS = ("", "www.", "m.", "blog.")


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, 1 if bad): the empty url, and each name with a few fronts, endings and paths."""
    out = [("", "", 0)]
    for names, paths, y in ((BAD, BAD_PATHS, 1), (GOOD, GOOD_PATHS, 0)):
        for i, name in enumerate(names):
            for k in range(4):
                out.append((f"{FRONTS[k]}{name}.{ENDINGS[(i + k) % len(ENDINGS)]}", paths[(i + 2 * k) % len(paths)], y))
    return out


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, hashed by FNV-1a, hosts and paths in different buckets."""
    rows, out = [], []
    for salt, texts in ((0, hosts), (1, paths)):
        parts = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" if t else b"" for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        for n in LENGTHS:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.full(m, 2166136261 ^ (salt * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint32(16777619)
            inside = owner[:m] == owner[n - 1 :]
            rows.append(owner[:m][inside])
            out.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out)


def logits(rows: np.ndarray, buckets: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    """Mean weight of a URL's n-grams, scaled by sqrt(n) so long paths don't drown a telling host."""
    count = np.bincount(rows, minlength=n)
    return np.bincount(rows, w[buckets], minlength=n) / np.sqrt(np.maximum(count, 1)) + bias


def fit(data: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) for labelled (host, path, 1 if bad)."""
    y = np.array([x[2] for x in data], float)
    rows, buckets = ngrams([x[0] for x in data], [x[1] for x in data])
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        off = (1 / (1 + np.exp(-logits(rows, buckets, len(y), w, bias))) - y) / len(y)
        w -= RATE * (np.bincount(buckets, (off * scale)[rows], minlength=BUCKETS) + PENALTY * w)
        bias -= RATE * off.sum()
    return w, bias


@lru_cache(1)
def fitted() -> tuple[np.ndarray, float]:
    return fit(labelled())


def split(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a url column; both empty without "://"."""
    url = F.coalesce(url, F.lit(""))
    # Greedy-free: everything behind the first "://", then cut at the first of / ? #.
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return host, path


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score (the model's probability of a bad url) of every row."""
    host, path = split(F.col(url))
    parts = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    model = fitted()

    def make():
        w, bias = model

        def f(b):
            z = logits(*ngrams(b["host"], b["path"]), len(b["host"]), w, bias)
            return b | {"score": (1 / (1 + np.exp(-z))).tolist()}

        return f

    scored = map_batches(parts, make, f"{key} {dict(parts.dtypes)[key]}, host string, path string, score double")
    scored = scored.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return scored.select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
