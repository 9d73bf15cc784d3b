"""The filter audit against a plain walk over every order."""

import random
import re
from itertools import permutations

import pytest

from tidemark.llm.filter_audit import audit, lattice_paths

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang, _ in docs:
        t = text or ""
        w = W.findall(t)
        own = {"A"} if len(w) < 100 else set()
        own |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs) else set()
        fails.append((lang or "", own, i is not None and i in good, i is not None and i in toxic))
    out, removed_all = {}, {}
    for part in {p for p, *_ in fails}:
        rows = [r for r in fails if r[0] == part]
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed_all[part, f] = removed_all.get((part, f), 0) + len(gone)
    return {k: (*v, removed_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "CD", "e#f", "g", "hij", "KLM", "no", "é", "ß x"]) + str(rng.randrange(rng.choice([5, 3000])))
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 60, 99, 100, 101, 150]))), rng.choice(["fr", "en", "", None]), i) for i in range(80)]
    docs += [(200 + i, rng.choice(docs)[1], "en", 0) for i in range(30)] + [(None, docs[0][1], "en", 0), (None, None, None, 0), (7, None, "fr", 0), (6, "", "fr", 0), (3, docs[3][1], "en", 0), (500, "x " * 30_000, "de", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120)] + [(1, 1, 0), (1, 0, 0), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, part int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(df, known).collect()}
    want = plain(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})
    assert audit(df.limit(0), known).count() == 0
    alone = audit(df, known.limit(0)).collect()
    assert sum(r.good_lost + r.toxic_lost for r in alone) == 0 and len(alone) == len(want)


def test_paths(spark):
    rows = lattice_paths(spark, "ABCDE").collect()
    assert len(rows) == 600 and len({(r.applied, r.bit) for r in rows}) == 80
    with pytest.raises(ValueError):
        lattice_paths(spark, "ABCDEFGH")
