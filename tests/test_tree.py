import hashlib
import random

from quarry.operators import manifest, tree
from quarry.plans.queries import kept_table
from quarry.session import shared_folder


def plain_paths(rows):
    by = {}
    for i, p, n in rows:
        if i is not None:
            key = (p is not None, p if p is not None else 0, n or "")
            by[i] = min(by.get(i, key), key)
    out = {}
    for i in by:
        names, at, seen = [], i, set()
        while True:
            if at in seen:
                out[i] = (None, "cycle")
                break
            if at not in by:
                out[i] = (None, "orphan")
                break
            seen.add(at)
            has, up, name = by[at]
            names.append(name)
            if not has:
                out[i] = ("".join("/" + x for x in reversed(names)), "ok")
                break
            at = up
    return out


def got(spark, rows):
    df = tree.paths(spark.createDataFrame(rows, "id long, parent long, name string"), kept_table(spark, "paths"))
    return {r.id: (r.path, r.status) for r in df.collect()}


def test_paths(spark):
    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(70)]
    odd = [(100, 100, "self"), (101, 100, "below"), (102, 103, "x"), (103, 104, "y"), (104, 102, "z"), (105, 999, "lost"), (106, 105, "also"), (107, None, None), (108, 107, ""), (None, 1, "none"), (109, 3, "b"), (109, 3, "a"), (109, 4, "c"), (110, None, "r"), (110, 5, "a")]
    assert got(spark, chain + odd) == plain_paths(chain + odd)
    r = random.Random(3)
    made = [(k, r.choice([None, r.randrange(300), r.randrange(max(1, k))]), f"d{k}") for k in range(260)]
    assert got(spark, made) == plain_paths(made) and {s for _, s in got(spark, made).values()} == {"ok", "orphan", "cycle"}
    assert got(spark, []) == {}


def m(spark, rows):
    return spark.createDataFrame([(n, len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in rows.items()], "name string, bytes long, sha256 string")


def test_folder_digests(spark):
    rows = {"a/b/1": "x", "a/b/2": "y", "a/c": "z", "top": "t", "a/bb/1": "x"}
    d = {r.folder: r for r in tree.folder_digests(m(spark, rows)).collect()}
    assert {f: (r.level, r.files, r.bytes) for f, r in d.items()} == {"": (0, 5, 5), "a": (1, 4, 4), "a/b": (2, 2, 2), "a/bb": (2, 1, 1)}
    assert d[""].digest != d["a"].digest
    other = {r.folder: r.digest for r in tree.folder_digests(m(spark, {**rows, "a/b/1": "y", "a/b/2": "x"}).repartition(3)).collect()}
    assert {f for f in d if other[f] != d[f].digest} == {"", "a", "a/b"}


def test_diff_looks_below_changed_folders_only(spark):
    r = random.Random(5)
    before = {f"{k % 3}/{k % 12}/{k}": f"text {k}" for k in range(300)}
    after = dict(before)
    for n in r.sample([x for x in before if x.startswith("1/")], 6):
        after[n] += "!"
    for n in r.sample([x for x in before if x.startswith("1/4/")], 3):
        del after[n]
    after |= {"1/new/a": "n", "9/9/9": "n", "top": "n"}
    after.pop("2/2/2")
    keep = kept_table(spark, "folders")
    b, a = (tree.Snapshot(spark, shared_folder(spark, "snap")).write(m(spark, x)) for x in (before, after))
    want = {(x.name, x.change) for x in manifest.diff(m(spark, before), m(spark, after)).where("change <> 'same'").collect()}
    assert {tuple(x) for x in tree.diff(b, a, keep).collect()} == want and len(want) > 10
    assert not {x[0] for x in tree.changed_folders(b, a, keep).collect()} & {"0", "0/0", "2/5"}
    assert tree.diff(b, b, keep).count() == 0 and tree.changed_folders(a, a, keep).count() == 0
    none = tree.Snapshot(spark, shared_folder(spark, "snap")).write(m(spark, {"x": "y"}).where("false"))
    assert tree.diff(none, b, keep).where("change = 'added'").count() == 300 and tree.diff(none, none, keep).count() == 0
