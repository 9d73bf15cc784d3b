"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_checked, staged, uniform

#: A document's rank is cut into this many steps, and each step again, before rows of one step are put in order.
STEPS = 1024
CYCLE = (3.0, 1.0, 2.0)


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float, cycle: tuple[float, ...], most: int) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size), one row a source.

    Sources in order of code point, null last, take the weights of `cycle` in turn and share `share` times all
    sizes by weight; no target passes `most` times its source's size, and what is cut off goes to the others by weight. The
    level that such sharing ends at is found by one sort: in order of (limit / weight), a source stays at
    its limit exactly if the level that the ones before it leave is no lower than its own ratio. Windows without
    a partition see a row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda total, part: F.sum(total).over(everything) - F.coalesce(F.sum(part).over(before), F.lit(0))
    level = F.try_divide(F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0)), left("weight", "weight"))
    full = ranked.withColumn("full", level >= F.col("limit") / F.col("weight"))
    rest = F.try_divide(
        F.sum("source_size").over(everything) * share - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything),
        F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    return full.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * rest)).select("skey", "source_size", "target")


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, share: float = 1.5, cycle: tuple[float, ...] = CYCLE, most: int = 2, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), and `row` if given, a column that tells rows apart; a row for each row of docs.

    Pareto order sampling: a document is to appear target / (weighted size of its source) times its weight (1 unless
    given), `most` at most. The whole part of that is certain copies. Its fraction p is the odds of one more: documents of
    a source are ranked by (u / (1 - u)) / (p / (1 - p)) with u a hash of the id, so reruns agree, and taken in that order
    until the words taken come as near the target as whole documents allow. The order is never made for
    a whole source in one task: sums over steps of the rank find the step in which the target falls, sums over steps within it the
    cell, and only its documents, about one in a million of a source, are sorted. The
    hot source's rows stay spread, as each row is joined to one small row of its source.

    A null text has size 0 and is taken 0 words; a null source is a source of its own; rows that are equal count each; ties of rank go by
    id and size; an empty table gives no rows; columns beside these are ignored."""
    size = n_words(text) if size is None else size
    carried = [] if row is None else [row]
    base = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("skey"), uniform(F.lit(seed), F.col(key)).alias("u"), *carried)
    base = staged(base, "mix-sizes")
    sizes = base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("weight") * F.col("size")).alias("weighted"))
    sizes = staged(sizes, "mix-sources")
    goals = staged(targets(sizes, share, cycle, most).join(sizes.select("skey", "weighted"), "skey"), "mix-targets")
    wanted = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target") * F.col("weight"), F.col("weighted")), F.lit(0.0)))
    p = F.col("wanted") - F.col("whole")
    odds = F.when(p > 0, F.col("u") / (1 - F.col("u")) * (1 - p) / p)
    place = F.coalesce(F.col("rank") / (1 + F.col("rank")), F.lit(1.0))
    step = lambda x: F.least(F.floor(x * STEPS), F.lit(STEPS - 1)).cast("int")
    ranked = (
        join_checked(base, goals, "skey").withColumn("wanted", wanted).withColumn("whole", F.floor("wanted")).withColumn("rank", odds)
        .withColumn("place", place).withColumn("step", step(F.col("place"))).withColumn("cell", step(F.col("place") * STEPS - F.col("step")))
        .withColumn("more", F.col("whole") < most))
    certain = ranked.groupBy("skey").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("short"))

    def fall(rows: DataFrame, by: str, short: DataFrame) -> DataFrame:
        """(skey, by, short): the value of `by` in which each source's target falls, and what is still short before it."""
        sums = rows.where("more").groupBy("skey", by).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("skey").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = join_checked(sums.withColumn("upto", F.sum("size").over(upto)), short, "skey")
        return staged(sums.where((F.col("short") >= F.col("upto") - F.col("size")) & (F.col("short") < F.col("upto"))).groupBy("skey").agg(F.min(by).alias(f"cut_{by}"), F.min(F.col("short") - F.col("upto") + F.col("size")).alias("short")), f"mix-{by}")

    steps = fall(ranked, "step", staged(certain, "mix-short"))
    inside = join_checked(ranked, steps.withColumnRenamed("short", "short_step"), "skey", "left")
    at_step = inside.where("step = cut_step")
    cells = fall(at_step, "cell", steps.select("skey", "short"))
    cut = join_checked(inside, cells.withColumnRenamed("short", "short_cell"), "skey", "left")
    # without a step in which it falls, a source's target is met by all that may be taken once more, or by none
    beyond = F.col("cut_step").isNull()
    split = F.col("more") & (F.col("step") == F.col("cut_step")) & (F.col("cell") == F.col("cut_cell"))
    order = Window.partitionBy("skey").orderBy(F.col("rank").asc_nulls_last(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_cell = cut.where(split).withColumn("once", (F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("short_cell")))
    below = F.col("more") & (beyond & p.__gt__(0) | (F.col("step") < F.col("cut_step")) | (F.col("step") == F.col("cut_step")) & (F.col("cell") < F.col("cut_cell")))
    others = cut.where(~F.coalesce(split, F.lit(False))).withColumn("once", F.coalesce(below, F.lit(False)))
    copies = F.col("whole") + F.col("once").cast("long")
    return sorted_cell.unionByName(others).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carried)
