"""Tables written once in a folder that the driver and all executors share, and joins whose small side is counted first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few numbers each) that may be sent to every executor.
BROADCAST_ROWS = 500_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. In local mode, and only there, it may be unset: then it is an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        at = _own_dir[0]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: the plan behind it runs once and its lineage ends here. options: of the Parquet writer."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """staged(df) and its number of rows, taken while they are written; a task that runs twice may count twice, so it is a bound where it isn't 0."""
    seen = Observation()
    return staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Joins with right sent to every executor if it has at most `most` rows, else by a shuffle, whose hot keys AQE splits.

    rows: how many right has, if known; else it is counted, so it must be cheap to count: a staged table or a small aggregate."""
    small = (right.limit(most + 1).count() if rows is None else rows) <= most
    return left.join(F.broadcast(right) if small else right, on, how)
