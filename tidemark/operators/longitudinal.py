"""Change over time and overlap of labelled sets: growth, Dice, consensus, heatmaps, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def growth(rows: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """rows with the change from the entity's previous value, absolute and relative (null after a zero)."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy(*order))
    return rows.withColumn("previous", before).withColumn("growth_absolute", F.col(value) - F.col("previous")).withColumn("growth_relative", F.try_divide(F.col("growth_absolute"), F.col("previous")))


def progression(rows: DataFrame, entity: str, order: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """(entity, timepoint, value) of entities with `least` values; a point's number is its place among all, gaps included."""
    own = Window.partitionBy(entity)
    placed = rows.withColumn("timepoint", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__n", F.count(value).over(own))
    return placed.where((F.col("__n") >= least) & F.col(value).isNotNull()).select(entity, "timepoint", value)


def order_violations(rows: DataFrame, entity: str, number: str, order: Sequence[str]) -> DataFrame:
    """Rows whose number is below the one before them in the entity's order."""
    return rows.withColumn("before", F.lag(number).over(Window.partitionBy(entity).orderBy(*order))).where(F.col("before") > F.col(number))


def trajectory(rows: DataFrame, timepoint: str, value: str) -> DataFrame:
    return rows.groupBy(timepoint).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def split_growth(rows: DataFrame, relative: str) -> DataFrame:
    """(direction, n, mean): increases hold zero; undefined changes are left out."""
    return rows.where(F.col(relative).isNotNull()).groupBy(F.when(F.col(relative) >= 0, "increase").otherwise("decrease").alias("direction")).agg(F.count("*").alias("n"), F.avg(relative).alias("mean_growth"))


def first_against_last(rows: DataFrame, entity: str, order: Sequence[str], value: str, kind: str = "level") -> DataFrame:
    """Delta and ratio of an entity's last value to its first; a level is degraded below 0.9, any other metric changed by over 0.1."""
    at = F.struct(*order)
    both = rows.groupBy(entity).agg(F.min_by(value, at).alias("baseline"), F.max_by(value, at).alias("final"), F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    ratio = F.try_divide(F.col("final"), F.col("baseline"))
    flag = (ratio < 0.9).alias("degraded") if kind == "level" else (F.abs(ratio - 1) > 0.1).alias("changed")
    return both.select(entity, "baseline", "final", (F.col("final") - F.col("baseline")).alias("delta"), ratio.alias("ratio"), flag)


def against_baseline(post: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: dict[str, str], percent: float = 10.0) -> DataFrame:
    """(keys, and for each metric its delta, ratio and flag) of rows that have a baseline of the same keys.

    metrics: name -> "level", degraded where the ratio falls under 1 - percent / 100, or any other kind, changed where it leaves 1 by more. Without a baseline value, or
    with 0, ratio and flag are null."""
    before = baseline.select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))
    out = []
    for m, kind in metrics.items():
        ratio = F.try_divide(F.col(m), F.col(f"__{m}"))
        flag = (ratio < 1 - percent / 100).alias(f"{m}_degraded") if kind == "level" else (F.abs(ratio - 1) > percent / 100).alias(f"{m}_changed")
        out += [(F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta"), ratio.alias(f"{m}_ratio"), flag]
    return post.join(before, list(keys)).select(*keys, *out)


def cells(rows: DataFrame, key: Sequence[str], values: str, inside: Column | None = None) -> DataFrame:
    """(key, pos, v): an array as a row a cell."""
    return rows.select(*key, F.posexplode(values).alias("pos", "v"))


def array_cells(rows: DataFrame, key: Sequence[str], values: str) -> DataFrame:
    """(key, pos, values): a computed array as a row a cell. Of posexplode the optimizer makes a filter on the array's size too, and computes the array twice; of posexplode_outer it doesn't."""
    return rows.select(*key, F.posexplode_outer(values).alias("pos", values)).where("pos is not null")


def overlap(a: Column, b: Column, empty: Column) -> dict[str, Column]:
    """Dice and Jaccard of two boolean arrays; `empty` where both are."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda z: z))
    na, nb = F.size(F.filter(a, lambda z: z)), F.size(F.filter(b, lambda z: z))
    return {"dice": F.when(na + nb == 0, empty).otherwise(2 * both / (na + nb)), "jaccard": F.when(na + nb == 0, empty).otherwise(both / (na + nb - both)), "a_voxels": na, "b_voxels": nb, "overlap_voxels": both}


def consecutive_dice(masks: DataFrame, entity: str, order: str, mask: str) -> DataFrame:
    """(entity, order, previous, pair_index, dice, jaccard, ...) of each mask (array of booleans) and the one before it; null where both are empty."""
    own = Window.partitionBy(entity).orderBy(order)
    paired = masks.withColumns({"__before": F.lag(mask).over(own), "previous": F.lag(order).over(own), "pair_index": F.row_number().over(own) - 2}).where("previous is not null")
    return paired.select(entity, order, "previous", "pair_index", *(c.alias(n) for n, c in overlap(F.col("__before"), F.col(mask), F.lit(None).cast("double")).items()))


def compare_masks(rows: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Two masks of a row: overlap, cells of either alone, difference of volume, without its sign, in % of the first (null if that is empty)."""
    m = overlap(F.col(a), F.col(b), F.lit(0.0))
    n, k, both = m["a_voxels"], m["b_voxels"], m["overlap_voxels"]
    return rows.select(*key, m["dice"].alias("dice"), m["jaccard"].alias("jaccard"), F.when(n > 0, 100.0 * F.abs(k - n) / n).alias("volume_difference_pct"), both.alias("overlap_voxels"), (n - both).alias("a_only_voxels"), (k - both).alias("b_only_voxels"))


def mask_summary(compared: DataFrame, low: float = 0.85) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), F.avg("dice").alias("mean_dice"), F.stddev_pop("dice").alias("std_dice"), F.min("dice").alias("min_dice"), F.max("dice").alias("max_dice"), F.count_if(F.col("dice") < low).alias("n_low"), F.avg((F.col("dice") < low).cast("double")).alias("low_fraction")).join(quantiles(compared, [], "dice", {"median_dice": 0.5}), F.lit(True), "left")


def consensus(voxels: DataFrame, group: Sequence[str], pos: str, member: str, inside: Column, votes: int) -> DataFrame:
    """(group, pos, n_votes) of the cells that min(votes, members) members hold."""
    members = voxels.groupBy(*group).agg(F.count_distinct(member).alias("__m"))
    held = voxels.groupBy(*group, pos).agg(F.count_if(inside).alias("n_votes"))
    return held.join(members, list(group)).where(F.col("n_votes") >= F.least(F.lit(votes), F.col("__m"))).drop("__m")


def heatmap(voxels: DataFrame, by: Sequence[str], pos: str, inside: Column, value: str) -> DataFrame:
    """(by, pos, n_inside, mean_value): how often a cell is held, and its mean over all members."""
    return voxels.groupBy(*by, pos).agg(F.count_if(inside).alias("n_inside"), F.avg(value).alias("mean_value"))


def volumes(voxels: DataFrame, by: Sequence[str], label: str, labels: Sequence[int]) -> DataFrame:
    """Cells of each label, their total and shares; shares of an empty volume are 0."""
    total = F.count_if(F.col(label).isin(*labels))
    parts = {f"volume_{x}": F.count_if(F.col(label) == x) for x in labels}
    out = voxels.groupBy(*by).agg(total.alias("total_volume"), *(c.alias(n) for n, c in parts.items()))
    return out.withColumns({f"proportion_{x}": F.coalesce(F.try_divide(f"volume_{x}", "total_volume"), F.lit(0.0)) for x in labels})


def centroid(voxels: DataFrame, by: Sequence[str], pos: str, inside: Column, shape: tuple[int, int, int]) -> DataFrame:
    """Mean coordinates, in row-major order of shape, of the cells inside; null if none is."""
    _, ny, nz = shape
    p = F.col(pos)
    x, y, z = F.floor(p / (ny * nz)), F.floor(p / nz) % ny, p % nz
    return voxels.groupBy(*by).agg(*(F.avg(F.when(inside, c)).alias(n) for n, c in (("cx", x), ("cy", y), ("cz", z))), F.count_if(inside).alias("n_inside"))


def composite_score(rows: DataFrame, metrics: dict[str, tuple[float, Column]]) -> Column:
    """Weighted mean of the metrics (weight, value in [0, 1]) that a row has."""
    have = [(F.when(c.isNotNull(), F.lit(w)).otherwise(0.0), F.coalesce(c * w, F.lit(0.0))) for w, c in metrics.values()]
    return F.try_divide(sum((v for _, v in have), F.lit(0.0)), sum((w for w, _ in have), F.lit(0.0)))


def falling(value: Column) -> list[Column]:
    """Sort keys, smallest first, that put the largest value first, NaN before all and null last."""
    v = value.cast("double")
    return [v.isNull().alias("none"), (~F.isnan(v)).alias("number"), (-v).alias("size")]


def best_of(rows: DataFrame, by: Sequence[str], score: str, tie: str, least: float | None = None) -> DataFrame:
    """The reference of each group: the best score, ties by the earliest; the earliest of all where no score reaches `least`. Aggregates only, so a group of any size is no single task's sort."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    found = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min_by(whole, F.struct(*falling(F.col(score)), F.col(tie).alias("tie"))).alias("__best"), F.min_by(whole, F.struct(F.col(tie).alias("tie"))).alias("__first"), F.max(score).alias("__top"))
    good = F.lit(True) if least is None else F.coalesce(F.col("__top") >= least, F.lit(False))
    return found.select(F.when(good, F.col("__best")).otherwise(F.col("__first")).alias("r")).select("r.*")


def worst_of(rows: DataFrame, by: Sequence[str], value: Column, key: Sequence[str]) -> DataFrame:
    """The row of each group with the largest value, rows without a value last; ties by key. An aggregate, not a sort of the group."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    order = F.struct(*falling(value), *(F.col(k).alias(f"k{i}") for i, k in enumerate(key)))
    return rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min_by(whole, order).alias("r")).select("r.*")


def first_supplied(rows: DataFrame, by: Sequence[str], order: str, metrics: Sequence[str]) -> DataFrame:
    """(by, metrics): of each group's rows the first by order that has the metric, each metric by itself; null if none has it."""
    return rows.groupBy(*by).agg(*(F.min_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in metrics))


# arrays of numbers


def bound(value: Column, then) -> Column:
    """then(value), the value computed once: a lambda's variable isn't replaced by what it stands for, as a column that is used twice may be."""
    return F.get(F.transform(F.array(value), then), 0)


def array_mean(values: Column) -> Column:
    """The mean; null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def array_quantile(ordered: Column, share: float) -> Column:
    """A quantile, between two values by distance, of a sorted array; null for an empty one."""
    at = F.lit(share) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def inside_of(values: Column, mask: Column | None) -> Column:
    """The values where the mask (array of booleans) holds, above zero without one."""
    if mask is None:
        return F.filter(values, lambda v: v > 0)
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def normalised_inside(values: Column, mask: Column | None, change) -> Column:
    """values changed where the mask holds (above zero without one), 0 elsewhere."""
    if mask is None:
        return F.transform(values, lambda v: F.when(v > 0, change(v)).otherwise(0.0))
    return F.zip_with(values, mask, lambda v, m: F.when(m, change(v)).otherwise(0.0))


def zscore_values(rows: DataFrame, values: str, out: str, mask: str | None = None, clip: tuple[float, float] | None = None, everywhere: bool = False) -> DataFrame:
    """rows with `out`: the array less the mean and over the population deviation (1e-8 at least) of what is inside the mask, cut to clip; 0 outside.

    everywhere: the mask is the whole array. A row's array is worked on where it is, in a few passes over it; nothing moves."""
    v, m = F.col(values), F.col(mask) if mask else None

    def scaled(s: Column) -> Column:
        z = lambda x: (x - s["mean"]) / s["deviation"]
        cut = z if clip is None else lambda x: F.least(F.greatest(z(x), F.lit(clip[0])), F.lit(clip[1]))
        return F.transform(v, cut) if everywhere else normalised_inside(v, m, cut)

    def spread(s: Column) -> Column:
        square = F.try_divide(F.aggregate(s["inside"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"])), F.size(s["inside"]))
        return bound(F.struct(s["mean"].alias("mean"), F.greatest(F.sqrt(square), F.lit(1e-8)).alias("deviation")), scaled)

    def centred(inside: Column) -> Column:
        return bound(F.struct(inside.alias("inside"), array_mean(inside).alias("mean")), spread)

    return rows.withColumn(out, bound(v if everywhere else inside_of(v, m), centred))


def minmax_values(rows: DataFrame, values: str, out: str, mask: str | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows with `out`: the array with 0 at the low and 1 at the high quantile of what is inside the mask, not cut off, 0 outside; a hair is added where they are equal."""
    v, m = F.col(values), F.col(mask) if mask else None

    def scaled(s: Column) -> Column:
        return normalised_inside(v, m, lambda x: (x - s["a"]) / s["width"])

    def ends(ordered: Column) -> Column:
        return bound(F.struct(array_quantile(ordered, low).alias("a"), array_quantile(ordered, high).alias("b")), lambda s: bound(
            F.struct(s["a"].alias("a"), F.when(s["a"] == s["b"], F.lit(1e-8)).otherwise(s["b"] - s["a"]).alias("width")), scaled))

    return rows.withColumn(out, bound(F.sort_array(inside_of(v, m)), ends))


def pad_or_crop(size: Column, target: Column) -> Column:
    """(pad_before, pad_after, crop_before, crop_after) for an axis, the odd cell after."""
    gap = target - size
    pad, crop = F.greatest(gap, F.lit(0)), F.greatest(-gap, F.lit(0))
    return F.struct(F.floor(pad / 2).alias("pad_before"), (pad - F.floor(pad / 2)).alias("pad_after"), F.floor(crop / 2).alias("crop_before"), (crop - F.floor(crop / 2)).alias("crop_after"))
