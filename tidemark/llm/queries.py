"""The operators' queries over the tables of a folder, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_classifier
from .common import WORD, load
from .decontamination import contaminated
from .filter_audit import audit
from .lexical_search import LOWER, TERM, UPPER, search
from .line_cleaning import BOILERPLATE, LOST, SYMBOL, with_measures
from .line_dedup import line_duplicates
from .mixing import mix
from .near_dup import near_duplicates
from .setsketch import similar_sets
from .sharding import shard
from .token_counts import token_counts
from .token_files import encode_round_trip


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"), 24)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(load(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "difference")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(load(spark, sf_dir, "documents"), shingle=3, words=1, width=32, most=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_measures(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean")


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_sets(load(spark, sf_dir, "documents"), shingle=2, alike=0.8)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), 20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_mixing, op3_sharding, op4_language_id, op5_line_dedup, op6_decontamination, op7_quality, op8_token_counts, op9_simhash, op10_line_cleaning, op11_setsketch, op12_lexical_search, op13_filter_audit, pipeline)}
COUNT = "len(regexp_extract_all(x, '{}'))".format
FAILS = f"""({COUNT("[|»›]")} >= 3 OR {COUNT(SYMBOL)} * 10 > length(x) OR ({COUNT(WORD)} >= 5 AND {COUNT("!")} * 3 > {COUNT(WORD)})
 OR ({COUNT(WORD)} >= 5 AND {COUNT(r"\p{Lu}")} * 5 > {COUNT(r"\p{L}")} * 3) OR ({COUNT(WORD)} >= 12 AND len(list_distinct(regexp_extract_all(x, '{WORD}'))) * 3 < {COUNT(WORD)}) OR regexp_matches(x, '{BOILERPLATE}'))"""
OP10_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOL}')) AS n_symbols, list_filter(l, lambda x: regexp_matches(x, '{WORD}')) AS full_lines,
 coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, list_filter(l, lambda x: NOT {FAILS}) AS good FROM w LEFT JOIN c USING (doc_id)),
k AS (SELECT *, length(regexp_replace(array_to_string(good, chr(10)), '[\\x20\\x09-\\x0D]+', '', 'g')) AS kept_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 base_failed, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(good) AS BIGINT) AS n_lines_removed, CAST(kept_chars AS BIGINT) AS kept_chars, NOT base_failed AND word_chars - kept_chars <= word_chars * {LOST} AS kept FROM k"""

TERMS_OF = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
OP12_SQL = f"""WITH t AS (SELECT row_number() OVER () AS d, doc_id, {TERMS_OF} AS t FROM documents),
h AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM t WHERE len(t) > 0),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, CAST(floor(1000 * ln((2 * h.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, h GROUP BY term, h.n),
i AS (SELECT i, item_id, term, count(*) AS often FROM (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {TERMS_OF} AS t FROM benchmark)) GROUP BY 1, 2, 3),
s AS (SELECT i, item_id, d, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * h.n) // h.l)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN p USING (term), h GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20"""
OP13_SQL = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
 regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
k AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
 count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT o, i, substr(o, CAST(i AS BIGINT), 1) AS f, substr(o, 1, CAST(i - 1 AS BIGINT)) AS before FROM o, range(1, 6) v(i)),
m AS (SELECT s.*, k.*, contains(fails, f) AS hit, translate(fails, before, '') <> fails AS gone FROM s, k),
g AS (SELECT part, o AS filter_order, CAST(i AS INT) AS step, f, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
 sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""

ORACLES: dict[str, str] = {"op10_line_cleaning": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
