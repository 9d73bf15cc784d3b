"""Lexical search against scores by definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import lexical_search
from tidemark.llm.lexical_search import TERM, best, search

T = re.compile(TERM)
FOLDED = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)


def plain(docs, items, k):
    terms = [T.findall((t or "").translate(FOLDED)) for _, t, *_ in docs]
    held, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for own in terms for t in set(own))
    out = []
    for item, text, *_ in items:
        found = []
        for (doc, *_), own in zip(docs, terms, strict=True):
            tf, score = Counter(own), 0
            m = 75 + 25 * len(own) * held // max(total, 1)
            for t in T.findall((text or "").translate(FOLDED)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def made(rng, n):
    return rng.choice([" ", "_", "-", "\n"]).join(rng.choice(["Ärger", "das", "THE", "the", "x9", "語", "É", "q"]) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(n))


def test_search(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, made(rng, rng.randrange(1, 40)), i) for i in range(150)]
    docs += [(300 - i, "the same copy", 0) for i in range(50)] + [(None, "the same copy", 0), (None, None, 0), (7, "", 0), (8, "__ --", 0), (9, docs[9][1], 0), (9, docs[9][1], 0), (900, made(rng, 30_000), 0)]
    items = [(i, made(rng, rng.randrange(1, 12)), 0) for i in range(12)] + [(3, "same Copy copy", 0), (3, "same Copy copy", 0), (None, "copy", 0), (20, None, 0), (21, "", 0), (22, "nowhere", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string, rank int")
    want = sorted(plain(docs, items, 20), key=str)
    assert sorted(map(tuple, search(df, wanted).collect()), key=str) == want
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 600)
    assert sorted(map(tuple, search(df, wanted).collect()), key=str) == want
    for a, b in ((df.limit(0), wanted), (df, wanted.limit(0)), (df.where("text = ''"), wanted)):
        assert search(a, b).count() == 0


def test_a_row_group_of_the_index_is_one_shard(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 200)
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(300)], "doc_id long, text string").coalesce(1)
    index, _ = lexical_search.build_index(df)
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in index.inputFiles()]
    assert index.count() > 20 and all(m.row_group(i).num_rows == 1 for m in groups for i in range(m.num_row_groups))


def test_best_keeps_ties_by_id():
    scores, ids, none = np.array([5, 9, 5, 5, 0, 5]), np.array([4, 8, 2, 0, 1, 3]), np.array([False, False, False, True, False, False])
    assert sorted(best(scores, ids, none, 3).tolist()) == [1, 2, 5]
    assert sorted(best(scores, ids, none, 5).tolist()) == [0, 1, 2, 3, 5]
    assert sorted(best(scores, ids, none, 6).tolist()) == [0, 1, 2, 3, 5]
    assert best(np.zeros(4, int), ids[:4], none[:4], 2).tolist() == []
