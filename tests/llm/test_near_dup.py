import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.components import components
from tidemark.llm.near_dup import majority_bits, near_duplicates, one_of_each, shingle_hashes
from tidemark.llm import simhash_links
from tidemark.llm.simhash_links import fingerprint_groups


def plain(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBÉ \t\x1c\x85 \n,", max_size=60), max_size=5))
def test_fingerprint(texts):
    h = [shingle_hashes(t, 3) for t in texts]
    got = majority_bits(np.array([*itertools.chain(*h)], np.uint64), np.array([*map(len, h)], np.int64), 1)
    assert got[:, 0].tolist() == [plain(t) for t in texts]


def test_long_text():
    t = " ".join(str(i % 700) for i in range(5000))
    h = shingle_hashes(t, 3)
    assert majority_bits(np.array(h, np.uint64), np.array([len(h)]), 1)[0, 0] == plain(t)


def brute(ids, prints, most=3):
    best = dict(enumerate(ids))
    while True:
        old = dict(best)
        for i, j in itertools.combinations(range(len(ids)), 2):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                best[i] = best[j] = min(best[i], best[j])
        if old == best:
            return [best[i] for i in range(len(ids))]


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 6, 200]))) for _ in range(60)]
    texts = base + [None, "", "A b", "a B"] + [b + " x y" for b in base[:20]] + base[:30]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, component_id long")
    got = {r.doc_id: (r.f0 % 2**64, r.component_id) for r in near_duplicates(docs).collect()}
    prints = [plain(t) for t in texts]
    assert [got[i][0] for i in ids] == prints
    assert [got[i][1] for i in ids] == brute(ids, prints)


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    prints = []
    for c in range(6):  # dense clusters that share whole segments, and chains
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.append(p ^ sum({1 << rng.randrange(10) for _ in range(rng.randrange(4))}))
        for _ in range(20):
            p ^= sum({1 << rng.randrange(64) for _ in range(3)})
            prints.append(p)
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, f0 long")
    got = {r.node: r.component for r in fingerprint_groups(nodes).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == brute(range(len(prints)), prints)


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (5, 6), (6, 5), (4, 4), (None, 3), (20, 21), (21, 22), (22, 23), (23, 24)], "a int, b int")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 7: 1, 8: 1, 9: 1, 5: 5, 6: 5, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d", "p"), (1, "a b c d", "p"), (2, "a b c d", "q"), (3, "z", "r")], "doc_id long, text string, f0 string")
    assert sorted(r.doc_id for r in one_of_each(docs, near_duplicates).collect()) == [1, 3]
    none = docs.limit(0)
    assert one_of_each(none, near_duplicates).count() == 0


def test_rows_without_an_id_are_linked_and_go(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, long, 1), (7, long, 2), (None, long + " x", 3), (None, "only", 4), (None, "only", 5), (8, "p q r", 6), (8, "s t u", 7), (None, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 int").coalesce(1)
    from tidemark.llm.near_dup import similar_documents

    for find in (near_duplicates, similar_documents):
        assert sorted(r.f0 for r in one_of_each(docs, find).collect()) == [2, 4, 6, 7, 9], find
    got = sorted((r.f0, r.component_id) for r in near_duplicates(docs.withColumnRenamed("f0", "n"), row="n").select("component_id", "n").withColumnRenamed("n", "f0").collect())
    assert got == [(1, 7), (2, 7), (3, 7), (4, None), (5, None), (6, 8), (7, 8), (8, 9), (9, 9)]


def test_five_word_stage_parameters(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    a = [word() for _ in range(400)]
    b = a[:200] + [word()] + a[201:]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(word() for _ in range(300)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 5, 6, 26, 58).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_similar_documents_against_exact_sets(spark):
    from tidemark.llm.near_dup import similar_documents

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    docs, want = [(900, None), (901, ""), (902, " "), (None, "a b")], {900: 900, 901: 900, 902: 900, None: None}
    for k in range(60):  # similarities from some 0.7 to 0.9: edits that lie apart each change five shingles
        a = [word() for _ in range(300)]
        b = list(a)
        for at in range(5, 5 + 10 * (3 + k % 9), 10):
            b[at] = word()
        sets = [{tuple(x[i:i + 5]) for i in range(296)} for x in (a, b)]
        near = len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (not near)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert got == want and 10 < sum(want[2 * k + 1] == 2 * k for k in range(60)) < 50
    assert similar_documents(df.limit(0)).count() == 0


def test_similar_documents_are_found_by_their_fingerprints_and_confirmed_by_their_sets(spark):
    from tidemark.llm.near_dup import similar_documents

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(25):  # a word changed
        a = [word() for _ in range(400)]
        texts += [a, a[:200] + [word()] + a[201:]]
    body = [word() for _ in range(40)] * 40
    texts += [body + [word() for _ in range(30)] for _ in range(8)]  # fingerprints by what repeats, sets by what doesn't
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [plain(" ".join(t), 5) for t in texts]
    near = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3
    want, pairs = list(range(len(texts))), list(itertools.combinations(range(len(texts)), 2))
    for i, j in pairs:
        if near(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            want[j] = want[i]
    assert len(set(want)) < len(texts) - 10 and sum(near(i, j) and i >= 50 for i, j in pairs) > 3
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # one key of so many minima that hardly a pair but of copies shares it: the fingerprints alone are measured
    got = {r.doc_id: r.component_id for r in similar_documents(df, bands=1, rows=2000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_group_of_copies_about_the_threshold_loses_no_link(spark):
    from tidemark.llm.near_dup import shared_rooms, similar_documents

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, texts = [word() for _ in range(220)], []
    for _ in range(120):  # up to nine words changed: some are like the base, some only like each other, most like none
        own = list(texts[-1] if texts and rng.random() < 0.2 else base)
        for at in rng.sample(range(220), rng.randrange(10)):
            own[at] = word()
        texts.append(own)
    sets = [{tuple(t[i:i + 5]) for i in range(216)} for t in texts]
    alike = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = list(range(120))
    for _ in range(120):
        for i, j in alike:
            group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # narrow keys: every pair of the threshold or more shares one, so that the links alone are measured
    got = {r.doc_id: r.component_id for r in similar_documents(df, bands=40, rows=3).collect()}
    assert [got[i] for i in range(120)] == group and 10 < len(set(group)) < 110
    numbers = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    rooms = {r.node: r.room for r in shared_rooms(spark.createDataFrame([(i, sorted(numbers[x] for x in s)) for i, s in enumerate(sets)], "node long, held array<long>"), 0.8).collect()}
    assert all(rooms[x] >= len(sets[i] & sets[j]) for i, j in alike for x in (i, j)) and len(rooms) < 120
    assert shared_rooms(spark.createDataFrame([], "node long, held array<long>"), 0.8).count() == 0


def test_exploded_keys_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = {}
    real = simhash_links.staged

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash_links, "staged", kept)
    nodes = real(spark.createDataFrame([(n, n) for n in range(0, 4000, 7)], "node long, f0 long"), "nodes")
    fingerprint_groups(nodes).count()
    assert "SortMergeJoin" in plans["simhash-hits"] and "Broadcast" not in plans["simhash-hits"]
