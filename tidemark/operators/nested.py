"""Checks as one nested document an entity, and back: entity, its visits, their items, their checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import Check

RESULT = "struct<passed:boolean,action:string,message:string,details:map<string,double>>"
CHECKS = f"map<string,{RESULT}>"
#: Fixed names of the document's parts; readers of it know them.
FILES = f"map<string,struct<checks:{CHECKS}>>"
STUDIES = f"map<string,struct<status:string,files:{FILES},study_level_checks:{CHECKS}>>"
DOCUMENT = f"struct<status:string,studies:{STUDIES},patient_level_checks:{CHECKS}>"
#: What checks_summary reads of a document.
SUMMARY = "struct<status:string,studies:map<string,struct<files:map<string,struct<checks:map<string,struct<passed:boolean>>>>>>>"
LEVELS = ("file", "study", "patient")


def nested(checks: DataFrame, entity: str, visit: str, item: str) -> DataFrame:
    """(entity, document) of checks (entity, visit, item, level, check_name, passed, action, message, details): a DOCUMENT for each entity, built from below.

    Rows are dealt by their entity once; all levels are then grouped where they are. A status is blocked where a check below it fails and blocks, else passed. Of several results of a
    check the worst stays: failed before passed, then by action, message and details from the end of their order. Levels are LEVELS, others are left out; so are rows without an entity or a check's name; a missing visit or item is named none."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    rows = checks.where(F.col("level").isin(*LEVELS) & F.col(entity).isNotNull() & F.col("check_name").isNotNull()).select(
        F.col(entity).alias("entity"), F.when(F.col("level") != "patient", name(visit)).alias("visit"), F.when(F.col("level") == "file", name(item)).alias("item"), "level", "check_name",
        F.struct("passed", "action", "message", "details").cast(RESULT).alias("result")).repartition("entity")
    worst = F.max_by("result", F.struct(~F.col("result.passed"), "result.action", "result.message", F.to_json("result.details")))
    blocking = F.coalesce(~F.col("result.passed") & (F.col("result.action") == "block"), F.lit(False))
    each = rows.groupBy("entity", "visit", "item", "level", "check_name").agg(worst.alias("result"), F.bool_or(blocking).alias("blocked"))
    status = F.when(F.bool_or("blocked"), "blocked").otherwise("passed").alias("status")
    mapped = lambda *e: F.map_from_entries(F.collect_list(*e))  # noqa: E731  of an entity's own rows
    groups = each.groupBy("entity", "visit", "item", "level").agg(mapped(F.struct("check_name", "result")).alias("checks"), F.bool_or("blocked").alias("blocked"))
    at = lambda level: F.first(F.when(F.col("level") == level, F.col("checks")), ignorenulls=True)
    none = F.create_map().cast(CHECKS)
    visits = groups.groupBy("entity", "visit").agg(
        status, F.bool_or("blocked").alias("blocked"), mapped(F.when(F.col("level") == "file", F.struct("item", F.struct("checks")))).alias("files"),
        F.coalesce(at("study"), none).alias("study_level_checks"), at("patient").alias("own"))
    whole = visits.groupBy("entity").agg(
        status, mapped(F.when(F.col("visit").isNotNull(), F.struct("visit", F.struct("status", "files", "study_level_checks")))).alias("studies"), F.coalesce(F.first("own", ignorenulls=True), none).alias("patient_level_checks"))
    return whole.select(F.col("entity").alias(entity), F.struct("status", "studies", "patient_level_checks").cast(DOCUMENT).alias("document"))


def _blocks(check: Check) -> Column:
    action = check.action if isinstance(check.action, Column) else F.lit(check.action)
    return F.coalesce(check.fails & (action == "block"), F.lit(False)) if check.enabled else F.lit(False)


def nested_rules_json(rows: DataFrame, entity: str, visit: str, item: str, columns: Sequence[str], rules: Callable[[Callable[[str], Column]], Sequence[Check]]) -> DataFrame:
    """(entity, value): the JSON that nested_json gives of nested over run_checks' rows of files, straight from rows: rules makes the checks of a row whose `columns` the function that it is given names.

    Rows are dealt by their entity and gathered by item, visit and entity with these columns only; checks, names and messages are made of the gathered rows, so that they are neither shuffled nor sorted.
    An item's part becomes text at once: what a lambda returns is copied at each level above it, and a text is copied faster than maps of structs."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    held = lambda *e: F.collect_list(F.struct(*e))  # noqa: E731  of an entity's own rows
    names = [c.name for c in rules(F.col)]
    if len(set(names)) < len(names):
        raise ValueError(f"checks of the same name: {names}")
    # repeats that don't stay block as well
    blocks = reduce(Column.__or__, (_blocks(c) for c in rules(lambda c: F.col("row")[c])))
    own = rows.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), name(visit).alias("visit"), name(item).alias("item"), F.struct(*columns).alias("row")).repartition("entity")
    items = own.groupBy("entity", "visit", "item").agg(F.collect_list("row").alias("rows"), F.bool_or(blocks).alias("blocked"))
    visits = items.groupBy("entity", "visit").agg(held("item", "rows").alias("items"), F.bool_or("blocked").alias("blocked"))
    whole = visits.groupBy("entity").agg(held("visit", "items", "blocked").alias("visits"), F.bool_or("blocked").alias("blocked"))

    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def result(r: Column, k: int) -> Column:
        made = rules(lambda c: r[c])[k].result()
        return F.struct(*(made[x].alias(x) for x in ("passed", "action", "message", "details")))

    def worst(held_rows: Column, k: int) -> Column:
        """Of the results of check k the one that stays."""
        order = lambda m, i: F.struct(~m["passed"], m["action"], m["message"], F.to_json(m["details"]), i.alias("i"))
        return bound(F.get(held_rows, F.array_max(F.transform(held_rows, lambda r, i: order(result(r, k), i)))["i"]), lambda r: result(r, k))

    joined = lambda texts: F.array_join(texts, ",")
    state = lambda hit: F.when(hit, "blocked").otherwise("passed")
    part = lambda results: F.to_json(F.struct(F.struct(*(r.alias(n) for n, r in zip(names, results, strict=True))).alias("checks")))

    def quoted(text: Column) -> Column:
        return bound(F.to_json(F.array(text)), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))

    def file(i: Column) -> Column:
        once = F.get(F.transform(i["rows"], lambda r: part([result(r, k) for k in range(len(names))])), 0)
        repeated = part([worst(i["rows"], k) for k in range(len(names))])
        return F.concat(quoted(i["item"]), F.lit(":"), F.when(F.size(i["rows"]) == 1, once).otherwise(repeated))

    def study(v: Column) -> Column:
        return F.concat(quoted(v["visit"]), F.lit(':{"status":"'), state(v["blocked"]), F.lit('","files":{'), joined(F.transform(v["items"], file)), F.lit('},"study_level_checks":{}}'))

    value = F.concat(F.lit('{"status":"'), state(F.col("blocked")), F.lit('","studies":{'), joined(F.transform("visits", study)), F.lit('},"patient_level_checks":{}}'))
    return whole.select(F.col("entity").alias(entity), value.alias("value"))


def nested_rules(rows: DataFrame, entity: str, visit: str, item: str, columns: Sequence[str], rules: Callable[[Callable[[str], Column]], Sequence[Check]]) -> DataFrame:
    """What nested gives of run_checks' rows of files, straight from rows: nested_rules_json read again."""
    return from_nested_json(nested_rules_json(rows, entity, visit, item, columns, rules), entity)


def nested_json(documents: DataFrame, entity: str) -> DataFrame:
    """(entity, value): each document as JSON; nulls have no field there."""
    return documents.select(entity, F.to_json("document").alias("value"))


def from_nested_json(rows: DataFrame, entity: str, value: str = "value", kind: str = DOCUMENT) -> DataFrame:
    """(entity, document) of JSON; null where it isn't a document. kind: the parts to read, DOCUMENT or SUMMARY."""
    return rows.select(entity, F.from_json(value, kind).alias("document"))


def flattened(documents: DataFrame, entity: str, visit: str = "visit", item: str = "item") -> DataFrame:
    """(entity, visit, item, level, check_name, passed, action, message, details): a row for each result in the documents, as nested was given them. A result without a field is passed, a warning, without message or details."""
    d = F.col("document")

    def results(checks: Column, level: str, v: Column, i: Column) -> Column:
        return F.transform(F.map_entries(F.coalesce(checks, F.create_map().cast(CHECKS))), lambda c: F.struct(
            v.cast("string").alias("visit"), i.cast("string").alias("item"), F.lit(level).alias("level"), c["key"].alias("check_name"), F.coalesce(c["value"]["passed"], F.lit(True)).alias("passed"),
            F.coalesce(c["value"]["action"], F.lit("warn")).alias("action"), F.coalesce(c["value"]["message"], F.lit("")).alias("message"), F.coalesce(c["value"]["details"], F.create_map().cast("map<string,double>")).alias("details")))

    nothing = F.lit(None)
    studies = F.map_entries(F.coalesce(d["studies"], F.create_map().cast(STUDIES)))
    files = F.flatten(F.flatten(F.transform(studies, lambda s: F.transform(F.map_entries(F.coalesce(s["value"]["files"], F.create_map().cast(FILES))), lambda f: results(f["value"]["checks"], "file", s["key"], f["key"])))))
    visits = F.flatten(F.transform(studies, lambda s: results(s["value"]["study_level_checks"], "study", s["key"], nothing)))
    every = F.concat(files, visits, results(d["patient_level_checks"], "patient", nothing, nothing))
    # no filter by the document: it would be made once for the filter and once more for the rows; a missing one has no results
    return documents.select(entity, F.explode(every).alias("r")).select(entity, F.col("r.visit").alias(visit), F.col("r.item").alias(item), "r.level", "r.check_name", "r.passed", "r.action", "r.message", "r.details")


def with_metric(rows: DataFrame, metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with `metric_value` and `threshold`, text: for a check's name the detail that says most of it, and the detail that is its threshold or, if there is none of that name, the text itself."""
    value = threshold = F.lit(None).cast("string")
    for check, (key, limit) in metrics.items():
        here = F.col("check_name") == check
        value = F.when(here, F.try_element_at("details", F.lit(key)).cast("string")).otherwise(value)
        threshold = F.when(here, F.coalesce(F.try_element_at("details", F.lit(limit)).cast("string"), F.lit(limit))).otherwise(threshold)
    return rows.withColumn("metric_value", value).withColumn("threshold", threshold)


def checks_summary(documents: DataFrame, entity: str) -> DataFrame:
    """(check_name, total, n_passed, n_failed) of the items' checks, and in a row without a name the entities: all, passed, blocked. Documents need no more than SUMMARY.

    Levels are unfolded one by one, by generated code, in a single pass: an entity counts where the first of each level, or none, stands."""
    d, values = F.col("document"), lambda c: F.map_values(F.col(c))
    rows = documents.select(d.isNotNull().alias("there"), d["status"].alias("status"), d["studies"].alias("studies"))
    rows = rows.select("there", "status", F.posexplode_outer(values("studies")).alias("i", "study")).select("there", "status", "i", F.col("study.files").alias("files"))
    rows = rows.select("there", "status", "i", F.posexplode_outer(values("files")).alias("j", "file")).select("there", "status", "i", "j", F.col("file.checks").alias("checks"))
    rows = rows.select("there", "status", "i", "j", F.posexplode_outer("checks").alias("k", "check_name", "result"))
    first = F.col("there") & (F.greatest(F.lit(0), "i", "j", "k") == 0)
    named, passed, blocked = F.col("k").isNotNull(), F.coalesce(F.col("result.passed"), F.lit(True)), F.col("status") == "blocked"
    tests = {"total": (named, first), "n_passed": (named & passed, first & ~blocked), "n_failed": (named & ~passed, first & blocked)}
    counts = rows.groupBy("check_name").agg(*(F.count_if(t).alias(f"{c}_{n}") for c, two in tests.items() for n, t in zip(("items", "entities"), two, strict=True)))
    both = F.array(*(F.struct(name.alias("check_name"), *(F.col(f"{c}_{n}").alias(c) for c in tests)) for n, name in (("items", F.col("check_name")), ("entities", F.lit(None).cast("string")))))
    nobody = documents.sparkSession.range(1).select(F.lit(None).cast("string").alias("check_name"), *(F.lit(0).cast("long").alias(c) for c in tests))  # a row also where no document is
    return counts.select(F.explode(both).alias("r")).select("r.*").unionByName(nobody).groupBy("check_name").agg(*(F.sum(c).alias(c) for c in tests))
