"""Decontamination takes rows, not ids."""

import random

import corpus_pipeline


def test_rows_without_an_id_or_with_one_that_repeats(spark, tmp_path):
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    item = prose(40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, prose(30) + " " + item, 1), (None, prose(70), 2), (7, prose(20) + " " + item + " " + prose(20), 3), (7, prose(70), 4), (8, None, 5), (None, "", 6), (9, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").coalesce(1)
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.item_id for r in got.collect()) == [2, 4, 5, 6]
