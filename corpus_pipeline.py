"""The corpus pipeline: documents through five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_checked, load, staged, with_rows
from tidemark.llm.decontamination import contaminated
from tidemark.llm.line_cleaning import clean_documents
from tidemark.llm.mixing import mix
from tidemark.llm.near_dup import one_of_each, similar_documents
from tidemark.llm.sharding import shard

#: Near duplicates: sets of shingles of five words with a similarity (Jaccard) of 0.8 or more, by their exact sets. SimHashes within 3 bits are all met, by multi-index hashing; of the pairs
#: at 0.8 that differ in more, 20 bands of 6 minima find 99.8 %.
NEAR = {"shingle": 5, "alike": 0.8, "most": 3, "bands": 20, "rows": 6}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold after their failing lines are gone; the others go."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents, the one with the smallest doc_id, null last; empty and null texts are one group."""
    return one_of_each(docs, similar_documents, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item; a row that holds one goes, also where its doc_id is null, and others of its doc_id stay. Null and empty texts stay."""
    rows = with_rows(docs, "doc_id", "checked-rows")
    found = staged(contaminated(rows, load(spark, sf_dir, "benchmark"), key="__row").select(F.col("doc_id").alias("__row")).distinct(), "contaminated")
    return join_checked(rows, found, "__row", "left_anti").drop("__row")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Each row has copies of its own, also where a doc_id is null or repeats."""
    rows = with_rows(docs, "doc_id", "mix-rows")
    copies = staged(mix(rows, row="__row").where("copies > 0").select("__row", F.col("copies").alias("__copies")), "copies")
    return join_checked(rows, copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its place there."""
    return shard(docs, 24)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixture), ("sharding", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
