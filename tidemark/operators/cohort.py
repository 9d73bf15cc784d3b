"""Cohort tables: what clinical records say of an entity, sequences under their required names, populations side by side, what studies hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def first_volume(text: Column) -> Column:
    """A volume written as text; null where it is no number."""
    return F.trim(text).try_cast("double")


def growth_status(text: Column) -> Column:
    """Whether a whole number, written as text, isn't 0; null where it is none."""
    return F.trim(text).try_cast("int") != 0


def n_controls(controls: Column) -> Column:
    """How many a map or an array of controls has; 0 without one."""
    return F.greatest(F.coalesce(F.size(controls), F.lit(0)), F.lit(0)).cast("long")


def inferred_modality(name: Column) -> Column:
    """The modality that a file's name tells, in any case: t1c before t1, t1 before t2, t2 before flair; null if it tells none."""
    low = F.lower(name)
    return F.when(low.contains("t1c"), "t1c").when(low.contains("t1"), "t1n").when(low.contains("t2"), "t2").when(low.contains("flair"), "flair")


def required_sequences(files: DataFrame, study: Sequence[str], name: str, required: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """(study, required, source, renamed): for each required name the file of a study that gets it: the one that has it, else the best orientation of it, `name-orientation`, by priority.

    The priority "none" is the name alone. Studies without a file for a name have no row for it; files that no row names go. Repeated names are one."""
    held = files.where(F.col(name).isNotNull()).groupBy(*study).agg(F.collect_set(name).alias("held"))  # a study's own files
    wanted = F.array(*(F.struct(F.lit(r).alias("required"), F.array(F.lit(r), *(F.lit(r if o == "none" else f"{r}-{o}") for o in priority)).alias("names")) for r in required))
    each = held.select(*study, "held", F.explode(wanted).alias("w")).select(*study, F.col("w.required").alias("required"), F.get(F.filter("w.names", lambda n: F.array_contains("held", n)), 0).alias("source"))
    return each.where("source is not null").withColumn("renamed", F.col("source") != F.col("required"))


def populations(rows: DataFrame, members: Mapping[str, Column]) -> DataFrame:
    """rows with `population`: each row once for each population that it is a member of; one pass serves them all."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in members.items())))
    return rows.withColumn("population", F.explode(names))


def population_statistics(rows: DataFrame, members: Mapping[str, Column], value: str) -> DataFrame:
    """(population, n, min, max, mean, std, median, q1, q3) of the values that aren't null; std is the sample's, 0 for one value."""
    own = populations(rows, members).where(F.col(value).isNotNull())
    moments = own.groupBy("population").agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    return moments.join(quantiles(own, ["population"], value, {"median": 0.5, "q1": 0.25, "q3": 0.75}), "population")


def population_histogram(rows: DataFrame, members: Mapping[str, Column], value: str, edges: Sequence[float]) -> DataFrame:
    """(population, low, high, n): counts between equally spaced edges, the last bin closed; empty bins count 0 in each population that has rows."""
    width, bins = edges[1] - edges[0], len(edges) - 1
    own = populations(rows, members)
    inside = F.col(value).between(edges[0], edges[-1])
    at = F.least(F.floor((F.col(value) - edges[0]) / width), F.lit(bins - 1)).cast("int")
    counts = own.groupBy("population").agg(*(F.count_if(inside & (at == k)).alias(f"n{k}") for k in range(bins)))
    return counts.select("population", F.explode(F.array(*(F.struct(F.lit(float(edges[k])).alias("low"), F.lit(float(edges[k + 1])).alias("high"), F.col(f"n{k}").alias("n")) for k in range(bins)))).alias("b")).select("population", "b.*")


def population_counts(rows: DataFrame, members: Mapping[str, Column], category: Column) -> DataFrame:
    """(population, value, n, place): categories, null as unknown, with their counts; place is 1 for the most common, ties by name."""
    counts = populations(rows, members).groupBy("population", F.coalesce(category.cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("population").orderBy(F.desc("n"), "value")))  # a row a category


def count_distribution(rows: DataFrame, entity: str, visit: str) -> DataFrame:
    """(n_visits, n_entities): how many entities have so many different visits."""
    return rows.groupBy(entity).agg(F.count_distinct(visit).alias("n_visits")).groupBy("n_visits").agg(F.count("*").alias("n_entities"))


def item_availability(rows: DataFrame, visit: Sequence[str], item: str) -> DataFrame:
    """(item, n_visits, share): how many visits hold an item, and of all visits."""
    pairs = rows.select(*visit, item).distinct()
    total = rows.select(*visit).distinct().agg(F.count("*").alias("__total"))
    return pairs.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n_visits")).join(F.broadcast(total)).withColumn("share", F.try_divide("n_visits", "__total")).drop("__total")  # one row


def projected(rows: DataFrame, columns: Sequence[str], renamed: Mapping[str, str]) -> DataFrame:
    """Those of the columns that rows have, some under another name."""
    return rows.select(*(F.col(c).alias(renamed.get(c, c)) for c in columns if c in rows.columns))


def discovered_studies(files: DataFrame, study: Sequence[str], item: str, required: Sequence[str], temporary: str = "_temp_") -> DataFrame:
    """(study, available, is_complete): which of the required items each study has, sorted; studies whose names begin like temporary folders are left out."""
    kept = files
    for c in study:
        kept = kept.where(~F.col(c).cast("string").startswith(temporary))
    held = kept.groupBy(*study).agg(F.array_sort(F.collect_set(F.when(F.col(item).isin(*required), F.col(item)))).alias("available"))
    return held.withColumn("is_complete", F.size("available") == len(set(required)))
