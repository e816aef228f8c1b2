"""Fill-in-the-middle transformation by run-length class encoding.

A text is stored as its maximal runs of white space and of other characters, with the number of units that end in the runs
up to each. A unit is a token `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a run of other characters ends one,
the white run before it belongs to it, and only a white run at the end of the text is a unit of its own. A run that ends k
units of length l (UNIT "char": every code point of a run is one) places its j-th unit's end at start + j * l / k. So a cut
after u units needs one binary search in the cumulative counts, for the run that holds it, and one multiplication: tokens
are never made, and a text of any length costs its code points and one number or two a run.

The two cuts, the form and the order of the parts follow from sha256 of `<seed>:<key>`, so reruns agree and rows may lie
anywhere. Each text is handled where it lies: no shuffle, no row is split, dropped or moved.

Defined results: a null text counts as empty; an empty text has no units and stays plain, as does a text that holds one of
the markers, so an output is read back in one way only; a null key hashes as the empty string; repeated rows get equal
outputs, as do two texts of one key their own cuts by equal hashes; white space alone is one unit; the longest text is cut
as the shortest; an empty table gives no rows. Only key and text are read: extra columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, table

SEED = 42
#: Percent of texts that are transformed, and of these, percent in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
#: Marks of prefix, suffix and middle. None may overlap with another or itself, so that a marker is where it was put.
MARKERS = ("<P>", "<S>", "<M>")


def runs(text: str, unit: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """The runs of a text: ends[i], the code points up to the end of run i, and units[i], the units that end in runs 0 to i."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (at == 32) | ((at >= 9) & (at <= 13))
    ends = np.append(np.flatnonzero(white[1:] != white[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)
    if unit == "char":
        return ends, ends
    ended = ~white[ends - 1] if len(at) else np.zeros(0, bool)
    if len(at):
        ended[-1] = True
    return ends, np.cumsum(ended)


def offset(ends: np.ndarray, units: np.ndarray, cut: int) -> int:
    """Code points before the end of unit number `cut` (0: before all)."""
    if cut == 0:
        return 0
    i = int(np.searchsorted(units, cut))
    start, before = (int(ends[i - 1]), int(units[i - 1])) if i else (0, 0)
    return start + (cut - before) * (int(ends[i]) - start) // (int(units[i]) - before)


def arranged(text: str, hashes: list[int], markers=MARKERS, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "word") -> tuple:
    """n, form, prefix and middle in code points, and the output of one text."""
    ends, units = runs(text, unit)
    n = int(units[-1]) if len(units) else 0
    h1, h2, h3, h4 = hashes
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    a, b = (offset(ends, units, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    (p, s, m), prefix, middle, suffix = markers, text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, **how) -> DataFrame:
    """key, n, form (plain, spm, psm), prefix_chars, middle_chars and output of every row. how: see arranged()."""
    markers = how.get("markers", MARKERS)
    if any(a[i:] == b[: len(a) - i] for a in markers for b in markers for i in range(len(a)) if i or a is not b):
        raise ValueError("markers must not overlap")

    def make():
        def f(b):
            out = []
            for k, x in zip(b["_key"], b[text]):
                h = hashlib.sha256(f"{seed}:{k or ''}".encode()).hexdigest()
                out.append(arranged(x or "", [int(h[i : i + 8], 16) for i in range(0, 32, 8)], **how))
            return {key: b[key]} | dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), zip(*out) if out else [[]] * 5))

        return f

    rows = docs.select(F.col(key).alias(key), F.col(text).alias(text), F.col(key).cast("string").alias("_key"))
    return map_batches(rows, make, f"{key} {dict(docs.dtypes)[key]}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: F.Column | str = "form", output: F.Column | str = "output", markers=MARKERS) -> F.Column:
    """The text that an output was made of. The parts hold no marker, so each marker is found where it was put."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "spm", F.concat(between(p, m), middle, between(s, p))).when(form == "psm", F.concat(between(p, s), middle, between(s, m))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


_HASH = ", ".join(f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t, {_HASH} FROM documents),
c AS (SELECT *, len(t)::BIGINT AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
             CASE WHEN text = '' OR h3 % 100 >= {RATE} OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM parts
"""
