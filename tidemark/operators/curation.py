"""Cohort curation as set algebra: every operator returns new tables, and what is rejected goes to a ledger.

Tables are flat, a row an item (entity, visit, item); `entity` and the like name the key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import join_checked, staged

LEDGER = ("entity", "visit", "item", "reason", "source_type", "stage")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows with `keep`: whether a row is the first of its key. The order must be total for the result to be determined."""
    return rows.withColumn("keep", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def completeness(items: DataFrame, entity: str, visit: str, item: str, required: Sequence[str], missing_allowed: int = 0) -> DataFrame:
    """(entity, visit, n_present, missing, complete) of each visit; missing lists the required items it lacks, sorted."""
    wanted = F.array(*map(F.lit, sorted(required)))
    got = items.groupBy(entity, visit).agg(F.collect_set(F.when(F.col(item).isin(*required), F.col(item))).alias("got"))
    missing = F.array_except(wanted, F.col("got"))
    return got.select(entity, visit, F.size("got").alias("n_present"), F.array_join(missing, ",").alias("missing"), (F.size(missing) <= missing_allowed).alias("complete"))


def with_enough(visits: DataFrame, entity: str, good: Column, least: int) -> DataFrame:
    """(entity, n_good, kept): whether an entity has `least` good visits."""
    n = F.count_if(good)
    return visits.groupBy(entity).agg(n.alias("n_good"), (n >= least).alias("kept"))


def cascade(visits: DataFrame, entity: str, visit: str, good: Column, least: int) -> DataFrame:
    """visits with `fate`: kept, visit_rejected, or entity_rejected where too few good ones are left."""
    judged = visits.withColumn("good", good)
    enough = with_enough(judged, entity, F.col("good"), least).select(entity, "kept")
    fate = F.when(~F.col("kept"), "entity_rejected").when(~F.col("good"), "visit_rejected").otherwise("kept")
    return judged.join(enough, entity).withColumn("fate", fate).drop("good", "kept")


def ledger(rows: DataFrame, reason: Column, source_type: str | Column, stage: int | Column, entity: str, visit: str, item: str) -> DataFrame:
    """Rejected rows in the ledger's columns; source_type and stage may differ by row, so that rows of all stages come of one pass."""
    source_type, stage = (x if isinstance(x, Column) else F.lit(x) for x in (source_type, stage))
    return rows.select(F.col(entity).cast("string").alias("entity"), F.col(visit).cast("string").alias("visit"), F.col(item).cast("string").alias("item"), reason.alias("reason"), source_type.alias("source_type"), stage.alias("stage"))


def funnel(final: DataFrame, rejected: DataFrame, stages: Sequence[int], exact: bool = False) -> DataFrame:
    """(stage, removed and remaining entities, visits, items) from kept rows and the ledger, both with entity, visit and item.

    By default an entity counts at every stage that rejects a row of it, as a ledger does; exact counts it at its last
    stage only, and not where rows of it are kept. The start holds what is left and all that any stage takes."""
    key = F.concat_ws("|", "entity", "visit")
    if exact:
        rejected = rejected.join(final.select("entity").distinct(), "entity", "left_anti").withColumn("last", F.max("stage").over(Window.partitionBy("entity")))
        whole = F.when(F.col("stage") == F.col("last"), F.col("entity"))
    else:
        whole = F.col("entity")
    gone = rejected.groupBy(F.coalesce("stage", F.lit(0)).alias("stage")).agg(F.count_distinct(whole).alias("entities_removed"), F.count_distinct(key).alias("visits_removed"), F.count("*").alias("items_removed"))
    left = final.agg(F.count_distinct("entity").alias("e"), F.count_distinct(key).alias("v"), F.count("*").alias("i"))
    running = Window.orderBy(F.desc("stage")).rowsBetween(Window.unboundedPreceding, -1)  # a row a stage
    out = gone.crossJoin(left)  # one row
    for part, whole_name in (("e", "entities"), ("v", "visits"), ("i", "items")):
        out = out.withColumn(f"{whole_name}_left", F.col(part) + F.coalesce(F.sum(f"{whole_name}_removed").over(running), F.lit(0)))
    return out.where(F.col("stage").isin(*stages)).drop("e", "v", "i")


def reasons(rejected: DataFrame) -> DataFrame:
    """(stage, reason, n) with comma-joined reasons counted one by one."""
    return rejected.select(F.coalesce("stage", F.lit(0)).alias("stage"), F.explode(F.split("reason", ",")).alias("reason")).groupBy("stage", F.trim("reason").alias("reason")).agg(F.count("*").alias("n"))


def renumber(visits: DataFrame, entity: str, visit: str, name: str, entity_order: Column | None = None, visit_order: Column | None = None) -> DataFrame:
    """(entity, visit, new_entity, new_visit): numbers without gaps, entities from 1, an entity's visits from 0.

    Entities are ranked over the distinct keys, dealt by ranges: counts of the ranges give the ranks between them, so no task sorts them all."""
    keys = visits.select(entity).distinct()
    by = F.col(entity) if entity_order is None else entity_order
    ranked = dense_rank_by_range(keys, by)
    inside = Window.partitionBy(entity).orderBy(F.col(visit) if visit_order is None else visit_order)
    new = F.format_string(f"{name}-%04d", "number")
    return (
        visits.select(entity, visit).distinct().withColumn("place", F.row_number().over(inside) - 1).join(ranked, entity)
        .select(entity, visit, new.alias("new_entity"), F.format_string(f"{name}-%04d-%03d", "number", "place").alias("new_visit")))


def dense_rank_by_range(keys: DataFrame, order: Column, number: str = "number") -> DataFrame:
    """keys with their place from 1 in an order that is total over them.

    Ranges are dealt, sorted and numbered in one job and written; the counts of the ranges come from what was written, so that both see the same ranges."""
    dealt = keys.withColumn("__order", order).repartitionByRange("__order").sortWithinPartitions("__order").drop("__order")
    dealt = staged(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")  # partition in the high bits, place in it in the low 33
    dealt = dealt.select(*keys.columns, F.shiftrightunsigned("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(number, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def close_gaps(numbered: DataFrame, entity: str, old: str, name: str) -> DataFrame:
    """(entity, old, new) for the entities whose number changes when numbers are closed up in string order."""
    ranked = dense_rank_by_range(numbered.select(entity, old).distinct(), F.col(old))
    return ranked.withColumn("new", F.format_string(f"{name}-%04d", "number")).where(F.col("new") != F.col(old)).select(entity, old, "new")


def apply_ids(rows: DataFrame, ids: DataFrame, entity: str, visit: str) -> DataFrame:
    """rows with new_entity and new_visit, null where the map has none."""
    return rows.join(ids.select(entity, visit, "new_entity", "new_visit"), [entity, visit], "left")


def trace_back(rejected: DataFrame, ids: DataFrame, entity: str, visit: str) -> DataFrame:
    """Rows with new ids under their old ones; ids that the map doesn't know together stay as they are."""
    old = ids.select(F.col("new_entity").alias("entity"), F.col("new_visit").alias("visit"), F.col(entity).cast("string").alias("old_entity"), F.col(visit).cast("string").alias("old_visit"))
    known = F.col("old_entity").isNotNull() & F.col("old_visit").isNotNull()
    return rejected.join(old, ["entity", "visit"], "left").withColumn("entity", F.when(known, F.col("old_entity")).otherwise(F.col("entity"))).withColumn("visit", F.when(known, F.col("old_visit")).otherwise(F.col("visit"))).drop("old_entity", "old_visit")


def missing_items(visits: DataFrame, items: DataFrame, visit: str, item: str, expected: Sequence[str]) -> DataFrame:
    """(item, present, missing, missing_rate) for each expected item, and a row `overall`."""
    spark = visits.sparkSession
    wanted = spark.createDataFrame([(x,) for x in expected], f"{item} string")
    n = visits.select(visit).distinct().agg(F.count("*").alias("n"))
    have = items.where(F.col(item).isin(*expected)).select(visit, item).distinct().groupBy(item).agg(F.count("*").alias("present"))
    each = wanted.join(have, item, "left").crossJoin(n).select(item, F.coalesce("present", F.lit(0)).cast("long").alias("present"), (F.col("n") - F.coalesce("present", F.lit(0))).alias("missing"))
    total = each.agg(F.lit("overall").alias(item), F.sum("present").alias("present"), F.sum("missing").alias("missing"))
    return each.unionByName(total).withColumn("missing_rate", F.try_divide(F.col("missing"), F.col("present") + F.col("missing")))


def exclude(visits: DataFrame, exclusions: DataFrame, entity: str, visit: str, least: int) -> DataFrame:
    """visits with `fate` after exclusions by hand: excluded, cascade (an affected entity with too few left) or kept."""
    hit = visits.join(exclusions.select(entity, visit).distinct().withColumn("__hit", F.lit(True)), [entity, visit], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    state = hit.groupBy(entity).agg(F.max("__hit").alias("__affected"), F.count_if(~F.col("__hit")).alias("__left"))
    fate = F.when(F.col("__hit"), "excluded").when(F.col("__affected") & (F.col("__left") < least), "cascade").otherwise("kept")
    return hit.join(state, entity).withColumn("fate", fate).drop("__hit", "__affected", "__left")


def reconcile(known: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): matched, known_only (a record without data) or present_only (data without a record)."""
    a = known.select(key).distinct().withColumn("__known", F.lit(True))
    b = present.select(key).distinct().withColumn("__present", F.lit(True))
    state = F.when(F.col("__known") & F.col("__present"), "matched").when(F.col("__known"), "known_only").otherwise("present_only")
    return a.join(b, key, "full_outer").select(key, F.coalesce(state, F.lit("present_only")).alias("state"))


def upsert(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the columns of updates where they have a value, and stubs for keys that base lacks."""
    new = updates.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return base.join(new, key, "full_outer").select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns), *(c for c in base.columns if c != key and c not in columns))


def latest(states: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key: a keyed table out of appended states."""
    return states.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def next_step(done: Column, steps: Sequence[str]) -> Column:
    """The first configured step that the array of completed ones lacks; null if all are done."""
    return F.get(F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.array_contains(done, s)), 0)


def with_lookup(rows: DataFrame, key: str, known: DataFrame, known_key: str, columns: dict[str, object]) -> DataFrame:
    """rows with columns of a table of known keys, each with its default where the key isn't known; a table that is small is sent, not shuffled."""
    new = known.select(F.col(known_key).alias(key), F.lit(True).alias("__known"), *(F.col(c).alias(f"__{c}") for c in columns))
    own = [c for c in rows.columns if c not in columns]
    return join_checked(rows, new, key, "left").select(*own, *(F.when(F.col("__known"), F.col(f"__{c}")).otherwise(F.lit(d)).alias(c) for c, d in columns.items()))


def known_or_rejected(rows: DataFrame, key: str, known: DataFrame, known_key: str, column: str, reason: str) -> DataFrame:
    """rows with the known column and `rejected`: null, or the reason where the lower-case key is not known. Kept and rejected rows come of one table."""
    lowered = rows.withColumn("__low", F.lower(key))
    found = with_lookup(lowered, "__low", known.withColumn("__low_key", F.lower(known_key)), "__low_key", {column: None})
    return found.drop("__low").withColumn("rejected", F.when(F.col(column).isNull(), F.concat(F.lit(f"{reason}: "), F.coalesce(F.col(key), F.lit("none")))))


def by_new_id(records: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """records under their entity's new id, those that the id map knows; ids has old_entity and new_entity."""
    pairs = ids.select(F.col("old_entity").cast("string").alias("__old"), "new_entity").distinct()
    return records.join(pairs, F.col(key).cast("string") == F.col("__old")).drop("__old")


def before_filter(current: DataFrame, rejected: DataFrame, entity: str, visit: str, item: str) -> DataFrame:
    """(entity, visit, item): what was there before rows were rejected: those that are left, under their old ids, and the rejected ones."""
    return current.select(entity, visit, item).unionByName(rejected.select(entity, visit, item)).distinct()


def issues_of_others(issues: DataFrame, left: DataFrame, entity: str, visit: str, least: int = 2) -> DataFrame:
    """(entity, n) of the entities with `least` issues or more on visits that are not left."""
    gone = issues.select(entity, visit).join(left.select(entity, visit).distinct(), [entity, visit], "left_anti")
    return gone.groupBy(entity).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def visits_per_entity(visits: DataFrame, entity: str, visit: str) -> DataFrame:
    """One row: entities, visits, and mean, population deviation, least and most visits of an entity."""
    each = visits.groupBy(entity).agg(F.count_distinct(visit).alias("n"))
    return each.agg(F.count("*").alias("total_entities"), F.sum("n").alias("total_visits"), F.avg("n").alias("mean_visits"), F.stddev_pop("n").alias("std_visits"), F.min("n").alias("min_visits"), F.max("n").alias("max_visits"))
