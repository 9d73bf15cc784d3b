"""Robust statistics, outliers, signal measures and distributions by group; built-in aggregates and windows only. Quantiles are exact, whatever a group's size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def intensity(rows: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Range, moments (population) and percentiles of a value, and the same of what is above zero."""
    v, above = F.col(value), F.when(F.col(value) > 0, F.col(value))
    out = rows.groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range"),
        F.avg(above).alias("non_zero_mean"), F.stddev_pop(above).alias("non_zero_std"), F.avg((v != 0).cast("double")).alias("non_zero_fraction"))
    return out.join(quantiles(rows, by, value, {f"p{round(100 * p)}": p for p in percentiles}), list(by))


def with_percentiles(rows: DataFrame, by: Sequence[str], value: str, percentiles: dict[str, float]) -> DataFrame:
    """rows with their group's percentiles as columns: one aggregate, joined back by the group."""
    return rows.join(quantiles(rows, by, value, percentiles), list(by))


def contrast_ratio(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(high - low) / (high + low) of the means above the upper and below the lower quartile."""
    v = F.col(value)
    means = with_percentiles(rows, by, value, {"__q1": 0.25, "__q3": 0.75}).groupBy(*by).agg(F.avg(F.when(v >= F.col("__q3"), v)).alias("high"), F.avg(F.when(v <= F.col("__q1"), v)).alias("low"))
    return means.select(*by, "high", "low", F.try_divide(F.col("high") - F.col("low"), F.col("high") + F.col("low")).alias("contrast"))


def snr(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean above zero over the deviation of the lowest twentieth; of all values where that is 0; infinite where that is 0 too."""
    v = F.col(value)
    parts = with_percentiles(rows, by, value, {"__p5": 0.05}).groupBy(*by).agg(F.avg(F.when(v > 0, v)).alias("signal"), F.stddev_pop(F.when(v <= F.col("__p5"), v)).alias("low"), F.stddev_pop(v).alias("all"))
    noise = F.when(F.col("low") > 0, F.col("low")).otherwise(F.col("all"))
    return parts.select(*by, "signal", noise.alias("noise"), F.when(noise > 0, F.col("signal") / noise).otherwise(float("inf")).alias("snr"))


def background_snr(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean from the upper quartile of the positive values on, over the deviation of their lowest twentieth; 0 without noise."""
    v = F.col(value)
    parts = with_percentiles(rows.where(v > 0), by, value, {"__p5": 0.05, "__p75": 0.75}).groupBy(*by).agg(F.avg(F.when(v >= F.col("__p75"), v)).alias("signal"), F.stddev_pop(F.when(v <= F.col("__p5"), v)).alias("noise"))
    return parts.withColumn("snr", F.when(F.col("noise") > 0, F.col("signal") / F.col("noise")).otherwise(0.0))


def foreground_snr(rows: DataFrame, by: Sequence[str], value: str, share: float = 0.75) -> DataFrame:
    """Mean over deviation, corrected for magnitude noise, of the values from a quantile of the positive ones on; 0 where they don't vary."""
    v = F.col(value)
    region = rows.join(quantiles(rows.where(v > 0), by, value, {"__from": share}), list(by)).where(v >= F.col("__from"))
    parts = region.groupBy(*by).agg(F.avg(v).alias("roi_mean"), F.stddev_pop(v).alias("roi_std"), F.count("*").alias("n_roi"))
    return parts.withColumn("snr_foreground", F.when(F.col("roi_std") > 0, F.col("roi_mean") / F.col("roi_std") * math.sqrt(2 / (4 - math.pi))).otherwise(0.0))


def signal_measures(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Background and foreground signal to noise and contrast to noise side by side; null where one has no values."""
    parts = [background_snr(rows, by, value).select(*by, F.col("snr").alias("snr_background")), foreground_snr(rows, by, value).select(*by, "snr_foreground"), cnr_bands(rows, by, value).select(*by, F.col("cnr").alias("cnr_high_low"))]
    out = rows.select(*by).distinct()
    for p in parts:
        out = out.join(p, list(by), "left")
    return out


def stability(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median, iqr) of the positive values."""
    q = quantiles(rows.where(F.col(value) > 0), by, value, {"median": 0.5, "__a": 0.25, "__b": 0.75})
    return q.select(*by, "median", (F.col("__b") - F.col("__a")).alias("iqr"))


def stability_histogram(rows: DataFrame, by: Sequence[str], value: str, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(by, bin, n, density) of the positive values between two of their quantiles; none where these are equal."""
    positive = rows.where(F.col(value) > 0)
    ranged = with_percentiles(positive, by, value, {"__lo": low, "__hi": high})
    return binned(ranged, by, value, bins)


def category_summary(rows: DataFrame, category: str, mean: str, std: str, k: float = 1.5) -> DataFrame:
    """(category, mean_across, std_across, mean_std, lower, upper, n_outliers) of a mean and a deviation a row, with outliers of the means by IQR."""
    flagged = iqr_outliers(rows, [category], mean, k)
    return flagged.groupBy(category).agg(F.avg(mean).alias("mean_across"), F.stddev_pop(mean).alias("std_across"), F.avg(std).alias("mean_std"), F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count_if("outlier").alias("n_outliers"))


def cnr_bands(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Contrast to noise of the bands [p25, p50) and [p50, p75] of the positive values."""
    v = F.col(value)
    banded = with_percentiles(rows.where(v > 0), by, value, {"__a": 0.25, "__b": 0.5, "__c": 0.75})
    low, high = F.when((v >= F.col("__a")) & (v < F.col("__b")), v), F.when((v >= F.col("__b")) & (v <= F.col("__c")), v)
    parts = banded.groupBy(*by).agg(F.avg(low).alias("m1"), F.avg(high).alias("m2"), F.var_pop(low).alias("v1"), F.var_pop(high).alias("v2"))
    return parts.select(*by, "m1", "m2", F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(F.col("v1") + F.col("v2"))).alias("cnr"))


def cnr_pairs(rows: DataFrame, by: Sequence[str], tissue: str, value: str) -> DataFrame:
    """Contrast to noise of each two tissues of a group."""
    each = rows.groupBy(*by, tissue).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a, b = (each.select(*by, F.col(tissue).alias(f"{tissue}_{s}"), F.col("m").alias(f"m{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    pairs = a.join(b, list(by)).where(F.col(f"{tissue}_a") < F.col(f"{tissue}_b"))
    return pairs.select(*by, f"{tissue}_a", f"{tissue}_b", F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt(F.col("va") + F.col("vb"))).alias("cnr"))


def iqr_outliers(rows: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """rows with the bounds and whether a value is strictly outside; groups join their own two percentiles, so no group gathers in a window."""
    out = with_percentiles(rows, by, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return out.withColumns({"lower": F.col("q1") - k * spread, "upper": F.col("q3") + k * spread}).withColumn("outlier", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))).drop("q1", "q3")


def zscore_outliers(rows: DataFrame, by: Sequence[str], value: str, most: float = 3.0) -> DataFrame:
    stats = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))
    return rows.join(stats, list(by)).withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > most, F.lit(False))).drop("__m", "__s")


def mad(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median, mad, n): the median and that of the distances from it."""
    apart = with_percentiles(rows, by, value, {"median": 0.5}).withColumn("__apart", F.abs(F.col(value) - F.col("median")))
    sizes = apart.groupBy(*by).agg(F.first("median").alias("median"), F.count(value).alias("n"))
    return sizes.join(quantiles(apart, by, "__apart", {"mad": 0.5}), list(by)).select(*by, "median", "mad", "n")


def mad_outliers(rows: DataFrame, by: Sequence[str], value: str, most: float = 3.5, least_rows: int = 1) -> DataFrame:
    """rows with the modified z; none is an outlier where the MAD is 0 or a group has fewer than least_rows values."""
    return with_modified_z(rows.join(mad(rows, by, value), list(by)), value, most, least_rows).drop("median", "mad", "n")


def with_modified_z(rows: DataFrame, value: str, most: float, least_rows: int = 1) -> DataFrame:
    """rows (value, median, mad, n) with `modified_z` and `outlier`."""
    z = F.when((F.col("mad") > 0) & (F.col("n") >= least_rows), 0.6745 * (F.col(value) - F.col("median")) / F.col("mad"))
    return rows.withColumn("modified_z", z).withColumn("outlier", F.coalesce(F.abs("modified_z") > most, F.lit(False)))


def group_summary(rows: DataFrame, by: Sequence[str], value: str, most: float = 3.5) -> DataFrame:
    """n, median, MAD and outliers of each group; null keys are groups too."""
    keyed = rows.withColumns({f"__k{i}": F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")) for i, c in enumerate(by)})
    keys = [f"__k{i}" for i in range(len(by))]
    flagged = with_modified_z(keyed.join(mad(keyed, keys, value), keys), value, most)
    own = [*(F.first(c).alias(c) for c in by), F.count("*").alias("n_cases"), F.count_if("outlier").alias("n_outliers"), F.avg(F.col("outlier").cast("double")).alias("outlier_fraction"), F.first("median").alias("median"), F.first("mad").alias("mad")]
    return flagged.groupBy(*keys).agg(*own).drop(*keys)


def unpivot_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(axis, mean, std, min, max, median) of each column."""
    long = rows.unpivot([], list(columns), "axis", "v")
    return long.groupBy("axis").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).join(quantiles(long, ["axis"], "v", {"median": 0.5}), "axis")


def outlier_sweep(rows: DataFrame, key: str, columns: Sequence[str], least_rows: int = 10) -> DataFrame:
    """(key, metric_outlier, ...) for each numeric column over all rows by MAD; nulls and columns with few values flag nothing."""
    long = rows.unpivot([key], list(columns), "metric", "v").where("v is not null")
    flagged = mad_outliers(long, ["metric"], "v", least_rows=least_rows)
    wide = flagged.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("metric") == c, F.col("outlier"))), F.lit(False)).alias(f"{c}_outlier") for c in columns))
    return rows.select(key).join(wide, key, "left").select(key, *(F.coalesce(f"{c}_outlier", F.lit(False)).alias(f"{c}_outlier") for c in columns))


# distributions


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal-width bin, the last one closed."""
    return F.least(F.floor(F.try_divide(value - low, high - low) * bins), F.lit(bins - 1))


def histogram(rows: DataFrame, by: Sequence[str], value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(by, bin, n, density); bounds are the group's own unless given, values outside are left out, empty bins have no row."""
    v = F.col(value)
    if low is None:
        bounds = rows.groupBy(*by).agg(F.min(v).cast("double").alias("__lo"), F.max(v).cast("double").alias("__hi"))
        rows = rows.join(bounds, list(by))
    else:
        rows = rows.withColumns({"__lo": F.lit(float(low)), "__hi": F.lit(float(high))})
    return binned(rows, by, value, bins)


def binned(rows: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """(by, bin, n, density) of the values between a row's __lo and __hi."""
    v = F.col(value)
    inside = rows.where((v >= F.col("__lo")) & (v <= F.col("__hi")) & (F.col("__hi") > F.col("__lo")))
    counted = inside.groupBy(*by, bin_of(v, F.col("__lo"), F.col("__hi"), bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # at most a row a bin
    return counted.withColumn("density", F.col("n") / total)


def filled(hist: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """The histogram with a row for each bin."""
    grid = hist.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(hist.select(*by, "bin", "density"), [*by, "bin"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def reference_histogram(hist: DataFrame, by: Sequence[str], bins: int, least: int = 2) -> DataFrame:
    """(bin, reference): the mean density over groups with shared edges; none with fewer than `least` groups."""
    return filled(hist, by, bins).groupBy("bin").agg(F.avg("density").alias("reference"), F.count("*").alias("__g")).where(F.col("__g") >= least).drop("__g")


def wasserstein(hist: DataFrame, by: Sequence[str], reference: DataFrame, bins: int, width: float) -> DataFrame:
    """(by, distance): the area between the cumulative distributions."""
    both = filled(hist, by, bins).join(reference, "bin")
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bin
    gap = both.withColumn("gap", F.abs(F.sum(F.col("density") - F.col("reference")).over(upto)))
    return gap.groupBy(*by).agg((F.sum("gap") * width).alias("distance"))


def entropy(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    return hist.where("density > 0").groupBy(*by).agg((-F.sum(F.col("density") * F.log2("density"))).alias("entropy"))


def otsu(hist: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """(by, threshold_bin): the first bin after which the variance between the two sides is largest."""
    full = filled(hist, by, bins)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*by)
    w = F.sum("density").over(upto)
    m = F.sum(F.col("density") * F.col("bin")).over(upto)
    total = F.sum(F.col("density") * F.col("bin")).over(everything)
    between = F.try_divide((total * w - m) * (total * w - m), w * (1 - w))
    return full.withColumn("between", F.when((w > 1e-12) & (w < 1 - 1e-12), between)).where("between is not null").groupBy(*by).agg(F.max_by("bin", F.struct("between", (-F.col("bin")).alias("first"))).alias("threshold_bin"))


def nmi(rows: DataFrame, by: Sequence[str], x: str, y: str, bins: int) -> DataFrame:
    """2 I(X; Y) / (H(X) + H(Y)) of the joint histogram over the group's ranges; 0 where neither varies."""
    stats = rows.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = rows.join(stats, list(by)).select(*by, F.coalesce(bin_of(F.col(x), F.col("x0"), F.col("x1"), bins), F.lit(0)).alias("i"), F.coalesce(bin_of(F.col(y), F.col("y0"), F.col("y1"), bins), F.lit(0)).alias("j"))
    joint = cell.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))  # bins * bins rows a group at most
    w = lambda *c: Window.partitionBy(*by, *c)
    p = joint.select(*by, "i", "j", (F.col("n") / F.sum("n").over(w())).alias("p"), (F.sum("n").over(w("i")) / F.sum("n").over(w())).alias("px"), (F.sum("n").over(w("j")) / F.sum("n").over(w())).alias("py"))
    parts = p.groupBy(*by).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), (-F.sum(F.col("p") * F.log("px"))).alias("hx"), (-F.sum(F.col("p") * F.log("py"))).alias("hy"))
    return parts.select(*by, F.coalesce(F.try_divide(2 * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(0.0)).alias("nmi"))


def ncc(rows: DataFrame, by: Sequence[str], x: str, y: str, small: float = 1e-8) -> DataFrame:
    """Normalised cross-correlation, with a small addition to each deviation."""
    parts = rows.groupBy(*by).agg(F.avg(F.col(x) * F.col(y)).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return parts.select(*by, ((F.col("xy") - F.col("mx") * F.col("my")) / ((F.col("sx") + small) * (F.col("sy") + small))).alias("ncc"))


def similarity(rows: DataFrame, by: Sequence[str], x: str, y: str, same_kind: Column, bins: int = 64, least: int = 100) -> DataFrame:
    """(by, n, nmi, ncc) of the pairs of values that are both above zero: ncc for groups of one kind (same_kind, true for all of a group's rows), nmi for the others; neither with fewer than `least` pairs."""
    valid = rows.where((F.col(x) > 0) & (F.col(y) > 0))
    groups = rows.groupBy(*by).agg(F.bool_and(same_kind).alias("__same"), F.count_if((F.col(x) > 0) & (F.col(y) > 0)).alias("n"))
    out = groups.join(nmi(valid, by, x, y, bins), list(by), "left").join(ncc(valid, by, x, y), list(by), "left")
    enough = F.col("n") >= least
    return out.select(*by, "n", F.when(enough & ~F.col("__same"), F.col("nmi")).alias("nmi"), F.when(enough & F.col("__same"), F.col("ncc")).alias("ncc"))
