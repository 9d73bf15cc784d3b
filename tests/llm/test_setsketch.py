"""SetSketch links against all pairs, the estimate against exact similarities."""

import random
import re

import numpy as np

from tidemark.llm.setsketch import BANDS, ROWS, estimates, merge, registers, similar_sets

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(sets, percent=80):
    """Component number of each set by all pairs; empty sets are linked with nothing."""
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def near_texts(rng, n_bases, n_edits):
    texts = []
    for _ in range(n_bases):
        base = [f"W{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(n_edits):
            own = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(0, 1 + len(base) // 8)):
                own[at] = f"new{rng.randrange(10**6)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(own).swapcase())
    return texts


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(11)
    texts = [*near_texts(rng, 25, 8), None, "", " \n", None, "one", "ONE", "two", "one two", "É", "é", "x y", "x y x y", "y x", "a b c d e f", "a b c d e f a b"]
    rows = [(i, t, i, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, registers string").repartition(5)
    for shingle in (2, 5):
        sets = [shingles(t, shingle) for t in texts]
        got = {r.doc_id: (r.n_shingles, r.component_id, r.group is None) for r in similar_sets(df, shingle).collect()}
        of = groups(sets)
        assert [got[i][:2] for i in range(len(texts))] == [(len(s), g) for s, g in zip(sets, of, strict=True)]
        assert all(got[i][2] == (of.count(of[i]) == 1) for i in range(len(texts)))
        assert 30 < sum(g != i for i, g in enumerate(of)) < len(texts) - 30
    assert similar_sets(df.limit(0), 2).count() == 0


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(500))
    rows = [(None, long, 1), (7, long, 2), (7, long + " x", 3), (None, "only this", 4), (None, "only this", 5), (8, "p q r", 6), (8, "s t u", 7), (None, None, 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1)
    got = sorted((r.n, r.n_shingles, r.component_id) for r in similar_sets(df, 2, row="n").collect())
    assert got == [(1, 499, 7), (2, 499, 7), (3, 500, 7), (4, 1, None), (5, 1, None), (6, 2, 8), (7, 2, 8), (8, 0, None), (9, 0, 9)]
    assert similar_sets(df, 2).count() == 9


def test_a_dense_group_about_the_threshold(spark):
    rng = random.Random(12)
    base, texts = [f"w{i}" for i in range(90)], []
    for _ in range(150):
        own = list(texts[-1] if texts and rng.random() < 0.2 else base)
        for at in rng.sample(range(90), rng.randrange(9)):
            own[at] = f"n{rng.randrange(10**6)}"
        texts.append(own)
    joined = [" ".join(t) for t in texts]
    want = groups([shingles(t, 2) for t in joined])
    got = {r.doc_id: r.component_id for r in similar_sets(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string"), 2).collect()}
    assert [got[i] for i in range(150)] == want and 5 < len(set(want)) < 145


def test_registers():
    rng = np.random.default_rng(1300)
    n = BANDS * ROWS
    pool = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    assert (registers(pool[:0], n) == 0).all()
    assert (merge(registers(pool[:5000], n), registers(pool[3000:], n)) == registers(pool, n)).all()
    for shared in (300, 1000, 1500, 1900):  # each set has 2,000 of the pool
        errors, alike = [], shared / (4000 - shared)
        for seed in range(20):
            x, y = registers(pool[:2000], n, seed), registers(pool[2000 - shared: 4000 - shared], n, seed)
            more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
            errors.append(estimates(more, less, n - more - less, np.array([0.5]))[0] - alike)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05
