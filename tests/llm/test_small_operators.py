"""Operators against plain versions on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tidemark.llm import language_id, quality_classifier
from tidemark.llm.decontamination import GRAM, LEAST, align, contaminated
from tidemark.llm.line_cleaning import clean_documents, with_measures
from tidemark.llm.line_dedup import line_duplicates, without_lines
from tidemark.llm.mixing import mix
from tidemark.llm.sharding import ring, shard, spill
from tidemark.llm.token_counts import token_counts

W = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocab=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.randrange(vocab)}x" for _ in range(n))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["b", "a", "c", None, "d"]), 1) for i in range(400)] + [(900, None, "a", 1), (901, "", "z", 1), (5, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(W.findall(t or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = set(), 1.5 * sum(size.values())
    while True:  # resharing until none is above
        free = [s for s in order if s not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            break
        full |= set(over)
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in order}
    largest = max(len(W.findall(t or "")) for _, t, _, _ in rows)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= largest / 2 + 1
    assert mix(docs.limit(0)).count() == 0


def test_mix_weights(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(300)], "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    got = mix(docs, weight=F.when(F.col("doc_id") < 100, 3.0).otherwise(1.0), share=0.5, cycle=(1.0,)).collect()
    heavy, light = (sum(r.copies for r in got if (r.doc_id < 100) == h) / n for h, n in ((True, 100), (False, 200)))
    assert abs(sum(r.taken for r in got) - 450) <= 3 and heavy > 2 * light


def test_shard(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), words(rng, 5), i) for i in range(500)] + [(7, None, 1), (7, None, 1), (None, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = shard(docs, 24, 32).collect()
    assert len(got) == len(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = {(i, t): (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert all((r.size, r.text_crc32) in want.values() for r in got)
    more = {r.doc_id: r.shard for r in shard(docs, 25, 32).collect() if r.doc_id is not None}
    stay = sum(more[r.doc_id] == r.shard for r in got if r.doc_id is not None)
    assert stay > 0.7 * len(rows)
    assert shard(docs.limit(0), 24, 8).count() == 0
    with pytest.raises(ValueError, match="no room"):
        ring(257, 256)
    nodes = ring(5, 10)
    plan = spill(nodes, [3] * 50, [30] * 5)
    assert sum(e - f for _, f, e, _ in plan) == 150 and all(sum(e - f for _, f, e, s in plan if s == k) == 30 for k in range(5))


def plain_measures(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_line_cleaning(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\n", "a b c a b c", "x\x1cy z\x85 é", "Home | About | Contact | Login"]
    texts += ["\n".join(words(rng, rng.randrange(1, 30), 3) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    good = "\n".join(words(rng, 20) + "." for _ in range(5))
    texts += [good, good + "\nAll rights reserved. " + words(rng, 5), good + "\n" + "\n".join("BUY NOW!! CHEAP!! GOODS!! TODAY!! ONLY!! " + str(i) for i in range(40))]
    docs = spark.createDataFrame([(i, t, "keep", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_chars long")
    got = {r.doc_id: r for r in with_measures(docs, prefix="_").collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = plain_measures(t)
        r = got[i]
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == (n, chars, symbols, dup, rep), repr(t)
        assert r._base_failed == (n < 50 or 100 * rep > 50 * n)
    n = len(texts)
    assert [got[i]._kept for i in (0, 1, n - 3, n - 2, n - 1)] == [False, False, True, True, False]
    kept = {r.doc_id: r for r in clean_documents(docs).collect()}
    assert kept[n - 2].text == good and kept[n - 2].n_chars == len(good) and kept[n - 2].words == "keep"
    assert clean_documents(docs.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def norm(line):
    return re.sub("[0-9]+", "0", re.sub(r"[^a-z0-9é]+", " ", line.lower())).strip(" ")


def alike(a, b):
    """By characters in lines of few words; else by words, and by characters where most of up to 150 words are in place."""
    wa, wb = a.split(" "), b.split(" ")
    in_chars = lambda: 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8
    if min(len(wa), len(wb)) <= 9:
        return in_chars()
    in_words = 1 - levenshtein(wa, wb) / max(len(wa), len(wb))
    return in_words >= 0.8 or in_words >= 0.72 and max(len(wa), len(wb)) <= 150 and in_chars()


def test_line_duplicates(spark):
    """Against all pairs by edit similarity, with nulls, short lines, ties, repeated rows and clashing names. Edits are few, so that no candidate is missed."""
    rng = random.Random(8)
    base = [words(rng, rng.choice([1, 3, 8, 30, 70, 200])) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice("abc") + x[k + 1:]
            lines.append(x.upper() + "!" if rng.random() < 0.3 else x)
        docs.append((i * 3 % 41, "\n".join(lines), "k"))
    docs += [(100, None, "k"), (101, "", "k"), (102, docs[3][1], "k"), (None, docs[4][1], "k"), (None, base[3][:-1] + "z\nonly here", "k"), (None, "only here", "k"), (100, "...\n12 345", "k"), (99, "0 - 7", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, key string").coalesce(1)
    got = line_duplicates(df).collect()
    lines = [(d is None, d or 0, k, p, norm(x)) for k, (d, t, _) in enumerate(docs) for p, x in enumerate((t or "").split("\n")) if norm(x)]
    texts = sorted({x[-1] for x in lines})
    group = {t: t for t in texts}
    find = lambda t: t if group[t] == t else find(group[t])
    linked = 0
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= 20 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and alike(a, b):
                group[find(a)] = find(b)
                linked += 1
    assert linked > 3
    seen, drop = set(), {}
    for _, _, k, p, t in sorted(lines):
        if find(t) in seen:
            drop.setdefault(k, []).append(p)
        seen.add(find(t))
    want = sorted(((docs[k][0], len((docs[k][1] or "").split("\n")), sorted(drop.get(k, []))) for k in range(len(docs))), key=str)
    assert sorted(((r.doc_id, r.n_lines, r.dropped) for r in got), key=str) == want
    assert any(r.doc_id is None and r.dropped == [0] for r in got)  # a line without an id is linked to one that has an id
    kept = without_lines(df.where("doc_id is not null"), line_duplicates(df.where("doc_id is not null")))
    assert kept.columns == df.columns
    assert line_duplicates(df.limit(0)).count() == 0


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[-1] - 1))
        row = new
        best = max(best, *row)
    return best


def test_alignment_scores():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64)
        assert align(a, b[None])[0][0] == smith_waterman(a.tolist(), b.tolist())


def test_contaminated(spark, monkeypatch):
    from tidemark.llm import decontamination

    rng = random.Random(9)
    items = [words(rng, rng.randrange(15, 50)) for _ in range(12)] + ["two words", "", None]
    rows = []
    for i in range(80):
        body = words(rng, rng.choice([0, 20, 300])).split()
        if i % 3 == 0:
            copy = rng.choice(items[:12]).split()
            for _ in range(rng.randrange(0, 1 + len(copy) // 8)):  # edits
                k = rng.randrange(len(copy))
                copy[k: k + 1] = rng.choice([[], ["new"], [copy[k].upper() + ",", "x1"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
        rows.append((i, " ".join(body), i))
    rows += [(200, None, 0), (201, "here are TWO words.", 0), (3, rows[3][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = lambda t: [x for x in (re.sub(r"[^a-z0-9]+", "", w.lower()) for w in (t or "").split()) if x]
    want, sure = {}, set()
    for d, t, _ in rows:
        for j, it in enumerate(items):
            if clean(it) and (s := smith_waterman(clean(it), clean(t)) / (2 * len(clean(it)))) >= LEAST:
                want[d, j] = s
                grams = lambda ws, n: {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)}
                if len(clean(it)) < GRAM or grams(clean(it), 5) & grams(clean(t), 5):
                    sure.add((d, j))
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert got.keys() <= want.keys() and sure <= got.keys() and len(sure) > 20
    assert all(abs(got[k].score - want[k]) < 1e-9 for k in sure)
    texts = {d: clean(t) for d, t, _ in rows}
    for (d, j), r in got.items():
        assert smith_waterman(clean(items[j]), texts[d][r.first_word:r.end_word]) / (2 * len(clean(items[j]))) == r.score
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)  # the same in blocks
    assert sure <= {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} <= want.keys()


def test_language(spark):
    rng = random.Random(1)
    vocab = {"en": "the and of with that this from have which there".split(), "de": "der und mit nicht auch eine sich werden haben über".split(), "fr": "le et dans pour avec être elle nous était cette".split()}
    text = lambda l, n: " ".join(rng.choice(vocab[l]) for _ in range(n))
    rows = [(i, text(l := rng.choice(list(vocab)), rng.randrange(5, 60)), l) for i in range(300)]
    rows += [(900, text("en", 60) + " " + text("de", 30), None), (901, None, "en"), (902, "12 !! 3", "de"), (903, "", "fr"), (900, text("fr", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    model = language_id.fit(docs.where(~language_id.held_out(docs.doc_id)))
    assert model[0] == ["de", "en", "fr"]
    got = language_id.predict(docs, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    held = [(i, l) for i, _, l in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(by[i][0].lang_pred == l for i, l in held) >= 0.97 * len(held)
    mixed = next(r for r in by[900] if len(r.langs) == 2)
    assert mixed.langs == ["en", "de"] and abs(mixed.score - 2 / 3) < 0.1
    assert all((by[i][0].lang_pred, by[i][0].score) == ("und", 0.0) for i in (901, 902, 903))
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(3)
    junk = lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words(rng, rng.randrange(30, 200)).split())
    rows = [(i, junk() if i % 4 == 0 else words(rng, rng.randrange(30, 200)), 9) for i in range(600)] + [(900, None, 1), (901, "", 1), (0, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(901, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got[:600] if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) > 0.9 * len(held)
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), None).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts(spark, rule):
    from tidemark.llm.token_counts import encoding

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["one\n\n\n  two three\n", None, "", "ééé 漢字\n\n\n\nend", "<|endoftext|> a\nb", "no end"]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, "x\ny", None)], "doc_id long, text string, source string")
    enc, length = encoding(path, pattern)
    got = {}
    for r in token_counts(docs, path, pattern, rule, ("source", "text")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        whole = f"s{i}\n{t or ''}"
        ids = enc.encode_ordinary(whole)
        sections, at = [], 0  # characters' sections
        for line in whole.splitlines(True) + ([""] if whole.endswith("\n") else []):
            sections += [len(sections) and sections[-1] + 1] * 0
            sections += [at] * len(line)
            at += 1
        n = [0] * at
        chars, raw = [], whole.encode()
        for c in whole:
            chars += [len(chars)] * 0 + [c] + [None] * (len(c.encode()) - 1)
        section_of_byte, heads, k = [], [], -1
        for c in chars:
            k += c is not None
            section_of_byte.append(sections[k])
            heads.append(c is not None)
        b = 0
        for t_id in ids:
            span = range(b, b + int(length[t_id]))
            b += int(length[t_id])
            own = [section_of_byte[x] for x in span]
            if rule == "most":
                count = {s: sum(heads[x] for x in span if section_of_byte[x] == s) for s in dict.fromkeys(own)}
                n[max(count, key=lambda s: (count[s], -s))] += 1
            else:
                n[own[0] if rule == "first" else own[-1]] += 1
        rows = sorted(got[i], key=lambda r: (r.first_char, r.field != "source", r.section))
        assert b == len(raw) and [r.n_tokens for r in rows if r.n_chars or rule] [: len(n)] == n[: len(rows)], (i, n, rows)
        assert sum(r.n_tokens for r in rows) == len(ids) and sum(r.n_chars for r in rows) == len(whole)
    assert sum(r.n_tokens for r in got[None]) == len(enc.encode_ordinary("\nx\ny"))
    assert token_counts(docs.limit(0), path, pattern).count() == 0


def test_whole_line_duplicates(spark):
    """Every exact copy and, from 20 characters on, nearly every pair by edit similarity alone: no filter of bits in the brute force."""
    rng = random.Random(12)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9)))
    pairs = []
    for k in range(150):
        line = [letters() for _ in range(rng.choice([6, 10, 20, 60]))]
        other = list(line)
        for at in rng.sample(range(len(line)), max(1, len(line) // 8)):
            other[at] = letters()
        pairs.append((" ".join(line), " ".join(other)))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) >= 20 and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8]
    docs = [(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    base = 1000
    docs += [(base, "Share on\n" + han), (base + 1, "share ON!\n" + han), (base + 2, "\n...\n" + han[:50] + "一丁" + han[52:]), (base + 3, "share it\nhome"), (base + 4, "homes")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_duplicates(df).collect()}
    found = sum(got[2 * i + 1] == [0] for i in range(len(pairs)))
    assert len(pairs) > 100 and found >= 0.95 * len(pairs) and not any(got[2 * i] for i in range(len(pairs)))
    assert [got[base + i] for i in range(5)] == [[], [0, 1], [2], [], []]
    assert line_duplicates(df.limit(0)).count() == 0


def test_contaminated_where_every_fourth_word_is_changed(spark):
    rng = random.Random(10)
    rows, items = [], []
    for i in range(8):
        item = [f"word{chr(97 + i)}{k}" for k in range(40)]
        items.append((i, " ".join(item)))
        copy = [f"other{rng.randrange(10**6)}" if k % 4 == i % 4 else w for k, w in enumerate(item)]
        rows += [(2 * i, " ".join(copy)), (2 * i + 1, " ".join(item[i % 4:i % 4 + 3]))]  # the copy, and a document that has one n-gram
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(2 * i, i) for i in range(8)}


def test_lines_alike_in_characters_only(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import line_dedup

    words = [f"{a}ord{b}wise{a}" for a in "bcdfghjk" for b in "lmnpqrst" for _ in range(4)]
    spoilt = lambda ws, every: " ".join(w[:-1] + "z" if i % every == 0 else w for i, w in enumerate(ws))
    rows = [(" ".join(words[:12]), spoilt(words[:12], 2), True), (" ".join(words[:12]), spoilt(words[:12], 1), True), (" ".join(words[:200]), spoilt(words[:200], 3), True), (" ".join(words[:200]), " ".join(reversed(words[:200])), False)]
    df = spark.createDataFrame(rows, "x_norm string, y_norm string, want boolean")
    for x in "xy":
        df = df.withColumn(f"{x}_signs", line_dedup.word_signs(F.col(f"{x}_norm"))).withColumn(f"{x}_words", F.transform(F.split(f"{x}_norm", " "), lambda w: F.xxhash64(w)))
    assert [r.got for r in df.select(line_dedup.alike_lines(0.8).alias("got")).collect()] == [r[2] for r in rows]


def test_lines_are_compared_after_pairs_are_dealt_to_tasks(spark, monkeypatch):
    from tidemark.llm import line_dedup

    plans, real = [], line_dedup.key_groups

    def kept(nodes, alike, verify):
        def seen(pairs):
            links = verify(pairs)
            plans.append(links._jdf.queryExecution().optimizedPlan().toString())
            return links
        return real(nodes, alike, seen)

    monkeypatch.setattr(line_dedup, "key_groups", kept)
    line = "the quick brown foxes jumped over seventeen lazy sleeping hounds near rivers"
    df = spark.createDataFrame([(i, f"{line} {c * 4}") for i, c in enumerate("abcdef")], "doc_id long, text string")
    assert [r.n_dropped for r in sorted(line_duplicates(df).collect())] == [0, 1, 1, 1, 1, 1]
    assert plans and all(-1 < p.find("levenshtein") < p.find("RepartitionByExpression") for p in plans)  # the comparison stands above


def test_line_sketches_read_lines_once_and_take_lines_shorter_than_a_window(spark):
    from tidemark.llm import line_dedup

    lines = spark.createDataFrame([(1, 7, "abc"), (2, 8, "ab cd"), (3, 9, "one two three four five six seven eight nine ten")], "key long, row long, norm string")
    found = line_dedup.line_sketches(lines, 3)
    assert sorted({(r.node, r.row, r.size) for r in found.collect()}) == [(1, 7, 3), (2, 8, 5), (3, 9, 48)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    df = spark.createDataFrame([(1, "abc\nAB cd"), (2, "ab cd!\nabd")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in line_duplicates(df, least_chars=3).collect()} == {1: [], 2: [0]}
