"""What the training-data operators share beside staged tables and joins with a checked side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import BROADCAST_ROWS, counted, join_checked, new_path, shared_dir, staged  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rows(docs: DataFrame, key: str, name: str) -> DataFrame:
    """docs with `__row`, a number that tells rows apart: the key where all rows have one and no two the same, else a row's place in a table written for it."""
    kind = docs.schema[key].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys"), F.count_distinct(key).alias("different")).first()
        if n.rows == n.keys == n.different:
            return docs.withColumn("__row", F.col(key).cast("long"))
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that the columns' values alone decide."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
