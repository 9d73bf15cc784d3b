import corpus_pipeline
from tidemark.llm.mixing import mix


def test_rows_without_or_with_repeated_ids_have_copies_of_their_own(spark):
    rows = [(None if i % 3 == 0 else i // 4, "w " * (1 + i % 7), "s", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").coalesce(2)
    got = corpus_pipeline.mixture(spark, docs, "")
    assert got.columns == docs.columns
    got = got.collect()
    want = sorted(n for r in mix(docs, row="n").collect() for n in [r.n] * r.copies)
    assert sorted(r.n for r in got) == want and any(r.doc_id is None for r in got)
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * sum(len(r[1].split()) for r in rows)) <= 7
