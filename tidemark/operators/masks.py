"""Labelled masks side by side: overlap by label, masks that belong together by their names, sizes over modalities, results under their own names again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import counted, join_checked

from .longitudinal import bound, compare_masks, overlap
from .quantiles import quantiles

#: What becomes of a propagated mask.
COMPARED, BAD_KEY, NO_MASK, NOT_FOUND = "compared", "unexpected key", "missing mask", "no independent mask"


def label_dice(rows: DataFrame, key: Sequence[str], a: str, b: str, labels: Sequence[int]) -> DataFrame:
    """(key, dice_total, dice_<label>) of two arrays of labels: null where neither has cells above 0, 0 throughout where one has none; a label that neither holds is null. Arrays of different length, or null, give nulls."""
    inside = {"total": lambda x: x > 0, **{str(n): (lambda x, n=n: x == n) for n in labels}}

    def counted_in(pairs: Column, name: str) -> Column:
        """[cells of a, of b, of both]."""
        add = lambda p: [inside[name](p["a"]).cast("int"), inside[name](p["b"]).cast("int"), (inside[name](p["a"]) & inside[name](p["b"])).cast("int")]
        return F.aggregate(pairs, F.array(F.lit(0), F.lit(0), F.lit(0)), lambda s, p: F.array(*(s[i] + x for i, x in enumerate(add(p)))))

    def count(pairs: Column) -> Column:
        return F.struct(*(counted_in(pairs, n).alias(n) for n in inside))

    def dice(s: Column) -> Column:
        both, one = (s["total"][0] == 0) & (s["total"][1] == 0), (s["total"][0] == 0) | (s["total"][1] == 0)
        return F.struct(*(F.when(both, F.lit(None)).when(one, F.lit(0.0)).otherwise(F.try_divide(2.0 * s[n][2], s[n][0] + s[n][1])).alias(f"dice_{n}") for n in inside))

    pairs = F.when(F.size(a) == F.size(b), F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")))
    whole = rows.withColumn("__dice", bound(pairs, lambda p: bound(count(p), dice)))
    return whole.select(*key, "__dice.*")


def split_key(key: Column) -> tuple[Column, Column]:
    """What is before and after the last underscore; null without one."""
    part = lambda i: F.when(key.contains("_"), F.regexp_extract(key, r"^(.*)_([^_]*)$", i))
    return part(1), part(2)


def compare_propagated(propagated: DataFrame, independent: DataFrame, cell_volume: float = 1.0) -> DataFrame:
    """(key, timestamp, modality, status, study, dice, ..., reference_dice): each propagated mask beside the independent mask of its time and modality and beside its reference.

    propagated has (key "time_modality", reference, mask), independent (study, modality, mask), masks being arrays of booleans. A study belongs to a time if its name ends with it after a dash; names are
    looked up by each of their ends, not compared one by one, and of several studies the first by name is taken. Rows that can't be compared keep their reason; repeated keys are rows each; volumes are cells times cell_volume."""
    time, modality = split_key(F.col("key"))
    rows = propagated.select("key", "reference", "mask", time.alias("timestamp"), modality.alias("modality"))
    parts = F.split("study", "-")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "-"))
    named = independent.where(F.col("study").contains("-") & F.col("mask").isNotNull()).select("study", "modality", F.explode(ends).alias("timestamp"))
    first, n = counted(named.groupBy("timestamp", "modality").agg(F.min("study").alias("study")), "mask-studies")
    held = independent.where(F.col("mask").isNotNull()).groupBy("study", "modality").agg(F.first("mask").alias("independent"))
    found = join_checked(rows, first, ["timestamp", "modality"], "left", rows=n).join(held, ["study", "modality"], "left")
    status = F.when(F.col("timestamp").isNull(), BAD_KEY).when(F.col("reference").isNull() | F.col("mask").isNull(), NO_MASK).when(F.col("independent").isNull(), NOT_FOUND).otherwise(COMPARED)
    volume = lambda m: F.size(F.filter(m, lambda x: x)) * cell_volume
    sized = found.withColumns({"status": status, "volume_independent": volume("independent"), "volume_propagated": volume("mask"), "reference_dice": overlap(F.col("reference"), F.col("mask"), F.lit(0.0))["dice"]})
    names = ["key", "timestamp", "modality", "status", "study", "volume_independent", "volume_propagated", "reference_dice"]
    measured = compare_masks(sized, names, "independent", "mask")
    return measured.select(*names[:4], *(F.when(F.col("status") == COMPARED, F.col(c)).alias(c) for c in measured.columns[4:]))


def volume_summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, std (population), min, max, q25, median and q75 of the values that aren't null; no row without any."""
    own = rows.where(F.col(value).isNotNull())
    moments = own.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return moments.join(quantiles(own, [], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), F.lit(True))


def largest_extent(items: DataFrame, study: Sequence[str], shape: str) -> DataFrame:
    """(study, n_items, max_dimension): the longest axis of all items of a study that have a shape, the side of the cube that holds each of them."""
    return items.where(F.col(shape).isNotNull() & (F.size(shape) > 0)).groupBy(*study).agg(F.count("*").alias("n_items"), F.max(F.array_max(shape)).alias("max_dimension"))


def remapped(names: DataFrame, outputs: DataFrame, name: str, output: str, target: Sequence[int], place: Column) -> DataFrame:
    """(names' columns, output, destination, shape_corrected, success, error): results that were made under working names, under their own again.

    names has a row for each working name, with original_shape (null: nothing was changed); of several outputs of a name the first is taken. shape_corrected says that the output has to be restored from target. Names without an output keep an error."""
    first, n = counted(outputs.where(F.col(output).isNotNull()).groupBy(name).agg(F.min(output).alias("output")), "named-outputs")
    found = join_checked(names, first, name, "left", rows=n)
    there = F.col("output").isNotNull()
    changed = F.coalesce(F.col("original_shape") != F.array(*map(F.lit, target)), F.lit(False))
    return found.select(*names.columns, "output", F.when(there, place).alias("destination"), (there & changed).alias("shape_corrected"), there.alias("success"), F.when(~there, F.concat(F.lit("No output found for "), F.coalesce(F.col(name), F.lit("none")))).alias("error"))
