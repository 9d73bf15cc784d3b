"""Semi-structured clinical records: two-header tables, nested JSON, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def two_header_records(rows: DataFrame, index: str, columns: Sequence[str], id_header: str) -> DataFrame:
    """(id, record map<string,string>) of a table whose first two rows are headers; keys are "top/second", a top header holding until the next.

    rows: text columns by position and `index`, the row's number from 0. Rows without an id and empty cells are left out."""
    heads = {r[index]: r for r in rows.where(F.col(index) < 2).collect()}  # two rows
    names, top = [], ""
    for c in columns:
        top = (heads[0][c] or "").strip() or top
        second = (heads[1][c] or "").strip()
        names.append(f"{top}/{second}" if second else top)
    at = names.index(id_header)
    body = rows.where(F.col(index) >= 2)
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("value")) for i, (c, n) in enumerate(zip(columns, names, strict=True)) if i != at))
    given = F.filter(entries, lambda e: e["value"].isNotNull())
    return body.select(F.nullif(F.trim(F.col(columns[at])), F.lit("")).alias("id"), F.map_from_entries(given).alias("record")).where("id is not null")


def empty_block(fields: Column) -> Column:
    """Whether a map of a visit's fields says nothing: volume null, 0 or "0", all else null."""
    volume = fields["vol"]
    rest = F.map_filter(fields, lambda k, v: (k != "vol") & v.isNotNull())
    return (volume.isNull() | (volume == "0")) & (F.size(rest) == 0)


def clinical_summary(rows: DataFrame, number: str, category: str, included: Column) -> DataFrame:
    """Counts, mean, sample deviation (0 for one) and median of the included, one row."""
    own = rows.where(included)
    return own.agg(F.count("*").alias("n"), F.avg(number).alias("mean"), F.coalesce(F.stddev_samp(number), F.lit(0.0)).alias("std"), F.count_if(F.col(category).isNull()).alias("n_unknown")).join(quantiles(own, [], number, {"median": 0.5}), F.lit(True), "left").select("n", "mean", "std", "median", "n_unknown")


def counted(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    """(value, n): categories with their counts, null as unknown."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def flatten_checks(nested: DataFrame, entity: str, files: str) -> DataFrame:
    """(entity, file, check_name, passed) out of map<file, map<check, struct<passed>>>."""
    return nested.select(entity, F.explode(files).alias("file", "checks")).select(entity, "file", F.explode("checks").alias("check_name", "c")).select(entity, "file", "check_name", F.col("c.passed").alias("passed"))


def log_iterations(text: Column, pattern: str) -> Column:
    """An array of (number, value) of the pattern's two groups, `inf` included."""
    n, v = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(n, v, lambda a, b: F.struct(a.try_cast("int").alias("iteration"), F.when(b == "inf", float("inf")).otherwise(b.try_cast("double")).alias("value")))
