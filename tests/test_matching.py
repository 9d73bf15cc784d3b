"""File search against a plain walk through folders and names."""

import random

from tidemark.operators.matching import find_files

NAMES = {"t1c": ["T1", "T1ce", "SET1C"], "t1n": ["T1SIN", "T1 simple"], "t2w": ["T2", "T1"], "flair": ["FLAIR", "T2FLAIR"]}


def plain(folder, category, files):
    """(path, kind) in one folder: exact names in any order of the best place, else longest names first unless another category's longer name fits."""
    own = NAMES.get(category, [])
    here = sorted((p, s) for f, s, p in files if f == folder and s is not None and p is not None)
    for name in own:
        for path, stem in here:
            if stem == name:
                return path, 0
    for name in sorted(own, key=len, reverse=True):
        for path, stem in here:
            low = stem.lower()
            if low.startswith(name.lower()) and not any(low.startswith(o.lower()) and len(o) > len(name) for c, g in NAMES.items() if c != category for o in g):
                return path, 1
    return None


def test_find_files(spark):
    rng = random.Random(4)
    stems = ["T1", "t1ce_P1", "T1SIN_2", "T1 simple", "T2FLAIR_x", "T2_P9", "t2flairs", "FLAIR", "SET1C", "other", "T", "", "set1cx", "T1sin"]
    files = []
    for f in ("a", "b", "c", "d", "e"):
        for s in rng.sample(stems, rng.randrange(0, 7)):
            files.append((f, s, f"root/{f}/P{rng.randrange(4)}/{s}.nrrd"))
    files += [("a", None, "root/a/none"), (None, "T1", "root/T1.nrrd"), ("b", "T1", None), *[("big", f"zz{i}", f"root/big/P9/zz{i}") for i in range(300)], ("big", "flair_9", "root/big/P9/flair_9")]
    wanted = [(i, [rng.choice(["a", "b", "c", "d", "e", "none", "big", None]) for _ in range(rng.randrange(0, 4))], rng.choice([*NAMES, "unknown", None]), [f"P{i % 5}", "P9"][: 1 + i % 2]) for i in range(120)]
    wanted += [(3, ["a"], "t1c", []), (None, ["a", "b", "c", "d", "e"], "flair", None), (200, None, "flair", ["P9"])]
    df = spark.createDataFrame([(*f, f[2].split("/") if f[2] else None) for f in files], "folder string, stem string, path string, parts array<string>").repartition(3)
    want_df = spark.createDataFrame(wanted, "id int, folders array<string>, category string, ids array<string>")
    for anywhere in (False, True):
        want = []
        for i, folders, category, ids in wanted:
            hits = [(plain(f, category, files), at) for at, f in enumerate(folders or []) if f is not None and plain(f, category, files)]
            if hits:
                want.append((i, *hits[0][0], hits[0][1]))
                continue
            best = None
            for x in (ids or []) if anywhere else []:
                got = plain("-", category, [("-", s, p) for _, s, p in files if p and x in p.split("/")])
                best = min(filter(None, (best, got and (got[1], got[0]))), default=None)
            want.append((i, best[1], best[0], -1) if best else (i, None, None, None))
        how = {"ids": "ids", "parts": "parts"} if anywhere else {}
        got = find_files(want_df, df, NAMES, "id", "folders", "category", **how).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert {r.kind for r in got} == {0, 1, None} and len({r.place for r in got}) > 3 - anywhere
    assert find_files(want_df.limit(0), df, NAMES, "id", "folders", "category").count() == 0
    assert all(r.path is None for r in find_files(want_df, df.limit(0), NAMES, "id", "folders", "category").collect())
