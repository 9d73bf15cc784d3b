"""Each stage of the corpus pipeline on small tables: nulls, empty texts, repeated rows, clashing names, empty tables, and the whole run against plain versions."""

import random
import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def made(spark, tmp_path):
    rng = random.Random(11)
    items = [prose(rng, 40) for _ in range(4)]
    rows = [(i, prose(rng, rng.randrange(60, 160)), "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "b") for i in range(8)]  # exact copies
    rows += [(200 + i, " ".join(w if k != 20 else "changed" for k, w in enumerate(rows[i][1].split())), None) for i in range(8)]  # near copies
    rows += [(300 + i, prose(rng, 60) + " " + items[i] + " " + prose(rng, 60), "c") for i in range(4)]  # passages of the benchmark
    rows += [(400, None, "a"), (401, "", "a"), (402, "too short", None), (5, rows[5][1], "b"), (None, rows[6][1], "b"), (None, prose(rng, 90), "a")]
    docs = spark.createDataFrame([(*r, "en", len(r[1] or ""), 1, 2) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, size int, keys int").coalesce(2)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return docs, items


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_stages_one_after_the_other(spark, tmp_path):
    docs, items = made(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and 400 not in (got := [r.doc_id for r in good.collect()]) and 402 not in got and len(got) == docs.count() - 3
    kept = stages["near_dedup"](spark, good, str(tmp_path))
    rows = kept.collect()
    assert kept.columns == docs.columns
    # plain: the smallest id, null last, of each group by pairs of sets
    have = sorted(good.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets, group = [shingles(r.text) for r in have], list(range(len(have)))
    for i in range(len(have)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = [have[i].doc_id for i in sorted(set(group))]
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, want)) and len(want) == len(have) - 18
    clean = stages["decontamination"](spark, kept, str(tmp_path))
    left = [r.doc_id for r in clean.collect()]
    assert sorted(map(str, left)) == sorted(map(str, (d for d in want if d is None or not 300 <= d < 304))) and clean.columns == docs.columns
    mixed = stages["mixing"](spark, clean, str(tmp_path))
    words = lambda rs: sum(len(WORD.findall(r.text or "")) for r in rs)
    assert mixed.columns == docs.columns and abs(words(mixed.collect()) - 1.5 * words(clean.collect())) <= 3 * 80
    placed = stages["sharding"](spark, mixed, str(tmp_path))
    sizes = [0] * 24
    for r in placed.collect():
        sizes[r.shard] += 1
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == placed.count()


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, _ = made(spark, tmp_path)
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
