"""Quality rules: base counts and a line-labelling conditional random field.

Every \\n-split line of a text is an observation; a linear-chain conditional random field with the two states content and
boilerplate scores lines by the features of features() and neighbours by a transition weight. Its weights maximise the
L2-penalised likelihood of the labelled lines below (forward-backward gradients, fitted once a task: about 60 lines, so
the fit doesn't grow with the data). Viterbi decoding runs for all documents of a batch at once, one line position at a
time. A document is kept if it passes the base rules and at least MIN_CONTENT of its words lie in content lines.

Defined results: null and empty texts have no words and fail the base rules; where two labellings of a text score the same,
each line takes content only if that scores strictly more; repeated rows are judged each for itself; an empty table gives no
rows; whole texts are read, whatever their length (a long one alone, at about twenty times its size). judge() reads key and
text only; keep() returns the columns of docs, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import map_batches, quoted, table

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT = 0.5
PENALTY = 0.05

_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)
_NO_DIGITS = str.maketrans("", "", "0123456789")
#: Phrases of notices that sites put on every page.
NOTICES = ("all rights reserved", "licensed under", "copyright", "cookie", "subscribe", "sign in", "log in", "click here", "read more", "privacy policy", "terms of use", "share this", "newsletter", "©")

#: The training set: documents of lines, "+" for content and "-" for boilerplate.
LINES = """
- Home | News | Sport | Weather | Contact
+ The river rose overnight and the lower road was closed before dawn.
+ Farmers moved their animals to the hills, where the ground was still dry.
- READ MORE!! SUBSCRIBE NOW!! CLICK HERE!! BEST DEALS!!
- Copyright 2019. All rights reserved.

+ In the second chapter the author returns to the village of her childhood.
+ She describes the mill.
+ Nobody there remembers the old name of the bridge, but the stones still carry it.
- Published under a Creative Commons licence. Some rights reserved.

- Startseite | Kontakt | Impressum | Datenschutz
+ Der Bericht beschreibt, wie die Stadt nach dem Krieg wieder aufgebaut wurde.
+ Viele Häuser standen leer, und erst nach Jahren kamen die Bewohner zurück.
- ANGEBOTE!! JETZT KAUFEN!! NUR HEUTE!! GRATIS!!
- Seite 2 von 17 | weiter

- $$$ Earn $500 a day $$$ *** no experience *** >>> apply <<<
- *** 50% off *** 70% off *** up to 90% off ***
- ### >> 100% free << ### <b>Start now & save $$$</b>
- >>> #deal #sale #bargain #free #win #today <<<

+ Le train partait à six heures, et la gare était encore vide.
+ On entendait seulement le vent sur les rails et une porte qui battait.
+ Puis les premiers voyageurs arrivèrent.
- Accueil | Actualités | Recherche | Abonnez-vous

+ La casa estaba al final de una calle estrecha, cerca del mercado.
+ Por la tarde los vecinos sacaban las sillas y hablaban hasta la noche.
- INICIO!! OFERTAS!! COMPRA AHORA!! ENVÍO GRATIS!!
- <<< >>> ### *** ### <<< >>>

- ACT NOW!!! CALL TODAY!! OFFER ENDS SOON!!
- HUGE SALE!! EVERYTHING MUST GO!! HURRY!! LAST DAYS!!
- HUGE SALE!! EVERYTHING MUST GO!! HURRY!! LAST DAYS!!
+ A study of 412 patients found no difference between the two groups.
+ The authors conclude that the shorter course is enough in most cases (see table 3).

+ We measured the temperature at four depths: 5, 10, 20 and 40 metres.
+ At the surface it rose by 2.3 degrees in ten years.
+ Below that, nothing changed.
- Share this | Print | Email | Tweet | Save
- 10 20 30 40 50 60 70 80 90 100

+ Short note.
+ It rained.
+ The committee met twice in March and agreed on the budget, on the dates and on a new chair.
- We use cookies to improve your experience. Read more in our privacy policy.
- Sign in to comment | Subscribe to our newsletter

- price | size | colour | stock | order
- small | large | red | 12 | buy
- small | large | blue | 7 | buy
+ Use of the tool is simple: put the blade under the edge, press, and turn it once.
+ If it does not move, warm the lid in water first
+ and then try again

+ The old harbour was rebuilt twice in the last century, first after the great storm and then again when the railway came, and both times the town paid for the work itself

+ Later that year he moved to the coast, rented a room above the bakery and began the long letter to his brother that fills the second half of this book, here with its notes
- Copyright 2008 by the publisher. All rights reserved.

+ Wer heute durch das Viertel geht, sieht davon fast nichts mehr, nur an der Mauer hinter der Schule steht noch ein Stein mit zwei Namen und einer Jahreszahl

+ Los domingos bajaban todos al río con mantas y pan y nadie volvía a casa antes de la noche aunque al otro lado ya se oyera la tormenta
"""

NAMES = ("blank", "1-2 words", "3-7 words", "8+ words", "any symbol", "symbols > 3 %", "symbols > 10 %", "all capitals", "shouts", "ends a sentence", "bar-separated", "digits > 20 %", "notice", "seen before")


def features(line: str, seen: bool) -> tuple[int, list[int]]:
    """The number of words, and the indices in NAMES of what holds for the line."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return 0, [0]
    out = [1 if n < 3 else 2 if n < 8 else 3]
    symbols = size - len(line.translate(_NO_SYMBOLS))
    if symbols:
        out.append(4)
        if symbols * 100 > 3 * size:
            out.append(5)
        if symbols * 10 > size:
            out.append(6)
        if line.count("|") * 4 >= n:
            out.append(10)
    low = line.lower()
    if low != line and line.upper() == line:
        out.append(7)
    if line.count("!!") * 4 >= n:
        out.append(8)
    if line.rstrip()[-1] in ".?:\"”":
        out.append(9)
    if (size - len(line.translate(_NO_DIGITS))) * 5 > size:
        out.append(11)
    if n < 40 and any(x in low for x in NOTICES):
        out.append(12)
    if seen:
        out.append(13)
    return n, out


def matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), len(NAMES) + 1))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    return x


@lru_cache(1)
def weights() -> tuple[np.ndarray, np.ndarray]:
    """(state weights: the log odds of content by feature, transitions[from, to]), fitted to LINES."""
    docs = []
    for block in LINES.strip().split("\n\n"):
        seen, rows, y = set(), [], []
        for line in block.split("\n"):
            rows.append(features(line[2:], line[2:] in seen)[1])
            seen.add(line[2:])
            y.append(int(line[0] == "+"))
        docs.append((matrix(rows), np.array(y)))
    w, t = np.zeros(len(NAMES) + 1), np.zeros((2, 2))
    for _ in range(400):
        gw, gt = -PENALTY * w, -PENALTY * t
        for x, y in docs:
            e = np.stack([np.zeros(len(x)), x @ w], 1)
            a, b = e.copy(), np.zeros_like(e)
            for i in range(1, len(x)):
                a[i] += np.logaddexp.reduce(a[i - 1][:, None] + t, axis=0)
            for i in range(len(x) - 2, -1, -1):
                b[i] = np.logaddexp.reduce(t + e[i + 1] + b[i + 1], axis=1)
            z = np.logaddexp.reduce(a[-1])
            gw = gw + x.T @ (y - np.exp(a + b - z)[:, 1])
            for i in range(1, len(x)):
                gt = gt - np.exp(a[i - 1][:, None] + t + e[i] + b[i] - z)
                gt[y[i - 1], y[i]] += 1
        w, t = w + 0.05 * gw, t + 0.05 * gt
    return w, t


def viterbi(scores: np.ndarray, counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best state of each line. scores: log odds of content of all lines, documents one after another with
    counts lines each (at least one)."""
    order = np.argsort(-counts, kind="stable")
    start, n = (np.cumsum(counts) - counts)[order], counts[order]
    back = np.zeros((len(scores), 2), np.int8)
    d = np.stack([np.zeros(len(n)), scores[start]], 1)
    last = d.copy()
    live = len(n)
    for k in range(1, int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k, side="left"))  # those with more than k lines
        at, step = start[:live] + k, d[:live, :, None] + t
        back[at] = from_ = step.argmax(1)
        d[:live] = np.take_along_axis(step, from_[:, None, :], 1)[:, 0]
        d[:live, 1] += scores[at]
        last[:live] = d[:live]
    state = np.zeros(len(scores), np.int8)
    end = start + n - 1
    state[end] = last.argmax(1)
    for k in range(int(n[0]) - 1 if len(n) else 0, 0, -1):
        at = start[: int(np.searchsorted(-n, -k, side="left"))] + k
        state[at - 1] = back[at, state[at]]
    return state


def base_counts(text: str) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    triples = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        covered = -1  # the last word already counted
        for i, x in enumerate(triples):
            if times[x] > 1:
                repeats += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), chars, symbols, repeats


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
NAMES_OUT = [x.split()[0] for x in OUT.split(", ")]


def judged(texts: list) -> list[list]:
    """The columns of OUT for a batch of texts."""
    w, t = weights()
    rows, words, counts, base, dups = [], [], [], [], []
    for x in texts:
        x = x or ""
        base.append(base_counts(x))
        seen: set = set()
        dup = k = 0
        for line in x.split("\n"):
            again = line in seen
            n, r = features(line, again)
            if line.strip(SPACE):
                dup += again
                seen.add(line)
            rows.append(r)
            words.append(n)
            k += 1
        counts.append(k)
        dups.append(dup)
    if not texts:
        return [[] for _ in NAMES_OUT]
    n_lines, n_words = np.array(counts, np.int64), np.array(words, np.float64)
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(length.sum()))
    scores = np.add.reduceat(w[flat], np.cumsum(length) - length) + w[-1]
    state = viterbi(scores, n_lines, t)
    first = np.cumsum(n_lines) - n_lines
    total = np.add.reduceat(n_words, first)
    share = (np.add.reduceat(n_words * state, first) / np.maximum(total, 1)).tolist()
    failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, _, _, r in base]
    n, chars, symbols, repeats = zip(*base)
    return [n, chars, symbols, dups, repeats, failed, counts, np.add.reduceat(state.astype(np.int64), first).tolist(), share, [not a and s >= MIN_CONTENT for a, s in zip(failed, share)]]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and OUT for every row."""
    return map_batches(docs.select(key, text), lambda: lambda b: {key: b[key]} | dict(zip(NAMES_OUT, judged(b[text]))), f"{key} {dict(docs.dtypes)[key]}, {OUT}")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs: rows are judged where they lie, without a join."""
    columns = docs.columns
    schema = ", ".join(f"{quoted(n)} {t}" for n, t in docs.dtypes)

    def make():
        def f(b):
            ok = judged(b[text])[-1]
            return {c: [x for x, k in zip(b[c], ok) if k] for c in columns}

        return f

    return map_batches(docs, make, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
