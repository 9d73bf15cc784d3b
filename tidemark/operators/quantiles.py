"""Exact quantiles of groups of any size: counts of bins narrow each rank down, so no task holds a large group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import counted, join_checked, staged

#: Values of a group that one task may hold, and the bins into which larger ones are counted.
GROUP_ROWS, BINS = 100_000, 1024
#: Ends of the order of doubles that aren't finite, and NaN, the last of all.
LOWEST, HIGHEST = float("-inf"), float("inf")


def bin_between(value: Column, lo: Column, hi: Column, bins: int, by_size: bool) -> Column:
    """The bin of a value between lo and hi, which are always in different bins; equal widths of the values, or with by_size of their logarithms either side of 0."""
    at = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if by_size else (lambda c: c / 2)  # half, as the width itself may be beyond the largest double
    share = F.try_divide(at(value) - at(lo), at(hi) - at(lo))
    return F.when(value >= hi, bins - 1).otherwise(F.greatest(F.least(F.coalesce(F.floor(share * (bins - 1)), F.lit(0)), F.lit(bins - 2)), F.lit(0)))


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, with the product of low and the sum rounded once together (a fused multiply-add), as the engine of the queries' SQL does.

    Where values are dense a quantile's neighbours are equal, and a last bit more or less would leave all values that are equal to it out of a range that it
    ends. The product's rounding error is taken from halves of its factors. Infinities, NaN and values near the largest double are taken plainly."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  x is computed once
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  the upper 26 bits

    def fused(v: Column) -> Column:
        a, b, y = v["a"], v["b"], v["y"]
        p, s = a * b, a * b + y
        lost = ((half(a) * half(b) - p) + half(a) * (b - half(b)) + (a - half(a)) * half(b)) + (a - half(a)) * (b - half(b))
        return F.when(F.greatest(F.abs(a), F.abs(y)) < 1e290, s + (((p - (s - (s - p))) + (y - (s - p))) + lost)).otherwise(s)

    return bound(F.struct(low.alias("a"), (F.lit(1.0) - part).alias("b"), (high * part).alias("y")), fused)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], group_rows: int = GROUP_ROWS, bins: int = BINS) -> DataFrame:
    """(by, a column for each of shares): the quantiles of each group's values that aren't null, between two values by distance; null keys are groups too. Infinities are the ends of the order and NaN comes after them.

    The values are written once, narrow, and counted as they are. If no group can be large, they are sorted. Else each rank that a quantile needs has an
    interval of values that holds it; as long as an interval has over group_rows values, they are counted in bins, and the bin with the rank, cut to the
    values it has, is the next. An interval of one value needs no more, and each round parts an interval's ends, so intervals shrink until few values are left; these are sorted.
    Rounds take bins of equal width and of equal ratio by turns, so values of very different size are narrowed down as fast."""
    keys = ["__quantile_all", *(f"__quantile_key{i}" for i in range(len(by)))]
    named = [F.lit(1).alias("__quantile_all"), *(F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias(k) for c, k in zip(by, keys[1:], strict=True))]
    values, total = counted(rows.select(*by, *named, F.col(value).cast("double").alias("__v")).where("__v is not null"), "quantile-values")
    first = [F.first(c).alias(c) for c in by]
    place = lambda n, p: F.lit(p) * (n - 1)
    at_place = lambda value_at, at: F.when(F.floor(at) == F.ceil(at), value_at(F.floor(at))).otherwise(between(value_at(F.floor(at)), value_at(F.ceil(at)), at - F.floor(at)))
    if total <= group_rows:
        found = values.groupBy(*keys).agg(*first, F.sort_array(F.collect_list("__v")).alias("all"))  # group_rows values at most
        return found.select(*by, *(at_place(lambda rank: F.get("all", rank.cast("int")), place(F.size("all"), p)).alias(n) for n, p in shares.items()))
    v = F.col("__v")
    inner = F.when(~F.isnan(v) & (v > LOWEST) & (v < HIGHEST), v)
    sizes = staged(values.groupBy(*keys).agg(*first, F.count("*").alias("n"), F.count_if(v == LOWEST).alias("below"), F.count(inner).alias("inner"), F.count_if(v == HIGHEST).alias("above"), F.min(inner).alias("lo"), F.max(inner).alias("hi")), "group-sizes")
    places = [(n, place(F.col("n"), p)) for n, p in shares.items()]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at), F.ceil(at)) for _, at in places))))
    spans = lambda open_ranks: open_ranks.select(*keys, "lo", "hi").distinct()  # noqa: E731  ranks in one interval are counted together
    wanted = sizes.select(*keys, F.explode(ranks).alias("rank"), "below", "inner", "above", "lo", "hi")
    finite = F.col("rank") - F.col("below")
    ends = F.when(finite < 0, LOWEST).when(finite < F.col("inner") + F.col("above"), HIGHEST).otherwise(float("nan"))
    ended = wanted.where((finite < 0) | (finite >= F.col("inner"))).select(*keys, "rank", ends.alias("at"))
    open_, done, turn = wanted.where((finite >= 0) & (finite < F.col("inner"))).select(*keys, "rank", finite.alias("left"), F.col("inner").alias("n"), "lo", "hi"), None, 0
    while True:
        open_, many = counted(open_, "open-ranks")
        small = open_.where((F.col("n") <= group_rows) | (F.col("lo") == F.col("hi")))
        done = small if done is None else done.unionByName(small)
        wide = open_.where((F.col("n") > group_rows) & (F.col("lo") < F.col("hi")))
        if not many or wide.isEmpty():
            break
        inside = join_checked(values.select(*keys, "__v"), spans(wide), keys, rows=many).where("__v between lo and hi")
        hist = inside.groupBy(*keys, F.col("lo").alias("from"), F.col("hi").alias("to"), bin_between(v, F.col("lo"), F.col("hi"), bins, turn % 2 == 1).alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
        each = wide.select(*keys, "rank", "left", F.col("lo").alias("from"), F.col("hi").alias("to")).join(hist, [*keys, "from", "to"])
        left = F.col("left") - F.coalesce(F.sum("n").over(upto), F.lit(0))
        open_ = each.withColumn("left", left).where("left >= 0 and left < n").select(*keys, "rank", "left", "n", "lo", "hi")
        turn += 1
    done, many = counted(done, "ranks")
    short = done.where("lo < hi")
    picked = join_checked(values.select(*keys, "__v"), spans(short), keys, rows=many).where("__v between lo and hi")
    picked = picked.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("__v")).alias("all"))  # group_rows values at most
    found = short.select(*keys, "rank", "left", "lo", "hi").join(picked, [*keys, "lo", "hi"]).select(*keys, "rank", F.get("all", F.col("left").cast("int")).alias("at"))
    each = found.unionByName(done.where("lo = hi").select(*keys, "rank", F.col("lo").alias("at"))).unionByName(ended)
    known = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("known"))  # two entries a quantile at most
    full = sizes.join(known, keys)
    value_of = lambda rank: F.try_element_at("known", rank.cast("long"))
    return full.select(*by, *(at_place(value_of, at).alias(n) for n, at in places))
