"""Quality checks as data: rules become rows (check_name, passed, action, message, details), rows roll up to decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A rule of one row. fails: when it fails (null: passes); details: numbers to keep; a disabled check passes."""

    name: str
    fails: Column
    action: str | Column = "warn"
    message: str | Column = ""
    details: dict[str, Column] | None = None
    enabled: bool = True

    def result(self) -> Column:
        failed = F.coalesce(self.fails, F.lit(False)) if self.enabled else F.lit(False)
        said = self.message if isinstance(self.message, Column) else F.lit(self.message)
        details = [x for k, v in (self.details or {}).items() for x in (F.lit(k), v.cast("double"))]
        kept = F.create_map(*details) if details else F.create_map().cast("map<string,double>")
        return F.struct(
            F.lit(self.name).alias("check_name"), (~failed).alias("passed"), F.when(failed, self.action).otherwise("warn").alias("action"),
            F.when(F.lit(not self.enabled), "Check disabled").when(failed, said).otherwise("").alias("message"), kept.alias("details"))


def run_checks(rows: DataFrame, keys: Sequence[str], checks: Sequence[Check], level: str = "file") -> DataFrame:
    """The checks' rows, one for each row and check: one pass over rows, one explode."""
    return rows.select(*keys, F.explode(F.array(*(c.result() for c in checks))).alias("c")).select(*keys, F.lit(level).alias("level"), "c.*")


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def spacing_of(directions: Column) -> Column:
    """The spacing of each axis: the length of its direction."""
    return F.transform(directions, vector_norm)


def determinant3(m: Column) -> Column:
    e = lambda i, j: F.get(F.get(m, i), j)
    return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))


def geometry_metrics(direction: Column, spacing: Column) -> Column:
    """struct of a volume's geometry: direction is 3 x 3, spacing an array of three numbers. An orientation is valid if its determinant is 1 or -1 up to a hundredth."""
    det, n = determinant3(direction), lambda i: F.get(spacing, i)
    return F.struct(
        det.alias("orientation_det"), (F.abs(F.abs(det) - 1) < 0.01).alias("orientation_valid"), *(n(i).alias(f"spacing_{a}") for i, a in enumerate("xyz")),
        (F.array_max(spacing) - F.array_min(spacing)).alias("spacing_max_diff"), (det * n(0) * n(1) * n(2)).alias("affine_det"))


def header_checks(dimension: Column, space: Column, directions: Column, sizes: Column, least_dim: int = 10, most_thickness: float = 10.0, spacing: tuple[float, float] = (0.2, 10.0), anisotropy: float = 20.0, det: tuple[float, float] = (1e-6, 1e6), fov_warn: float = 3.0, fov_block: float = 5.0, least_extent: float = 100.0) -> list[Check]:
    """Checks that need an image's header only: header, scout, spacing, affine, field of view, coverage."""
    first = F.slice(sizes, 1, 3)
    steps = spacing_of(directions)
    extent = F.zip_with(first, steps, lambda n, s: n * s)
    ratio = F.when(F.array_min(extent) > 0, F.array_max(extent) / F.array_min(extent)).otherwise(float("inf"))
    uneven = F.try_divide(F.array_max(steps), F.array_min(steps))
    d = F.abs(determinant3(directions))
    issues = F.array_join(F.filter(F.array(
        F.when(F.array_min(steps) < spacing[0], "spacing below minimum"), F.when(F.array_max(steps) > spacing[1], "spacing above maximum"), F.when(uneven > anisotropy, "too anisotropic")), lambda x: x.isNotNull()), "; ")
    return [
        Check("nrrd_header", (dimension != 3) | (space.isNull() & directions.isNull()), "block", "Not a volume in a known space"),
        Check("scout_localizer", (F.size(sizes) < 3) | (F.array_min(first) < least_dim) | (F.array_max(steps) > most_thickness), "block", "Scout or localizer"),
        Check("voxel_spacing", F.length(issues) > 0, "warn", issues, {"anisotropy": uneven}),
        Check("affine", F.isnan(d) | (d < det[0]) | (d > det[1]), "block", "Degenerate affine", {"determinant": d}),
        Check("fov_consistency", ratio > fov_block, "block", "Field of view ratio", {"ratio": ratio}),
        Check("fov_ratio", (ratio > fov_warn) & (ratio <= fov_block), "warn", "Field of view ratio", {"ratio": ratio}),
        Check("brain_coverage", F.array_min(extent) < least_extent, "warn", "Small extent", {"min_extent": F.array_min(extent)}),
    ]


def same_set_check(items: DataFrame, entity: str, visit: str, item: str) -> DataFrame:
    """(entity, passed): whether all visits of an entity hold the same items."""
    sets = items.groupBy(entity, visit).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("s"))
    return sets.groupBy(entity).agg((F.count_distinct("s") == 1).alias("passed"))


def one_value_check(items: DataFrame, by: Sequence[str], value: str, ignore: Sequence[str] = ("unknown", "error")) -> DataFrame:
    """(by, passed): whether a group has at most one value, leaving unknown ones out."""
    return items.groupBy(*by).agg((F.count_distinct(F.when(~F.col(value).isin(*ignore), F.col(value))) <= 1).alias("passed"))


def status(passed: Column, action: Column) -> Column:
    """blocked over warned over passed, as an aggregate."""
    return F.when(F.bool_or(~passed & (action == "block")), "blocked").when(F.bool_or(~passed), "warned").otherwise("passed")


def roll_up(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, n_failed, reasons): reasons are the blocking checks, sorted and joined; unknown if there is none."""
    blocking = F.when(~F.col("passed") & (F.col("action") == "block"), F.col("check_name"))
    reasons = F.array_join(F.array_sort(F.collect_set(blocking)), ",")
    return checks.groupBy(*keys).agg(status(F.col("passed"), F.col("action")).alias("status"), F.count_if(~F.col("passed")).alias("n_failed"), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("unknown")).alias("reasons"))


def roll_up_rules(rows: DataFrame, keys: Sequence[str], rules: Sequence[Check]) -> DataFrame:
    """What roll_up gives of run_checks' rows, straight from rows: a count a rule, so no row becomes several."""
    failed = {c.name: F.count_if(F.coalesce(c.fails, F.lit(False)) if c.enabled else F.lit(False)) for c in rules}
    counts = rows.groupBy(*keys).agg(*(n.alias(f"__{name}") for name, n in failed.items()))
    blocking = F.array_compact(F.array(*(F.when(F.col(f"__{c.name}") > 0, F.lit(c.name)) for c in sorted(rules, key=lambda c: c.name) if c.action == "block")))
    total = sum((F.col(f"__{name}") for name in failed), F.lit(0).cast("long"))
    reasons = F.array_join(blocking, ",")
    state = F.when(F.size(blocking) > 0, "blocked").when(total > 0, "warned").otherwise("passed")
    return counts.select(*keys, state.alias("status"), total.alias("n_failed"), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("unknown")).alias("reasons"))


def severity_rules(rows: DataFrame, entity: str, rules: Sequence[Check], names: Sequence[str]) -> DataFrame:
    """What severity_matrix gives of run_checks' rows, straight from rows."""
    worst = lambda c: F.max(F.when(F.coalesce(c.fails, F.lit(False)) if c.enabled else F.lit(False), 1.0 if c.action == "block" else 0.5).otherwise(0.0))
    return rows.groupBy(entity).agg(*(worst(c).alias(c.name) for c in rules if c.name in names))


def issues_by_type(checks: DataFrame) -> DataFrame:
    """(check_name, n) of blocking issues of files."""
    return checks.where((F.col("level") == "file") & ~F.col("passed") & (F.col("action") == "block")).groupBy("check_name").agg(F.count("*").alias("n"))


def check_summary(checks: DataFrame) -> DataFrame:
    """(check_name, total, n_passed, n_failed, pass_rate) of checks of files."""
    out = checks.where(F.col("level") == "file").groupBy("check_name").agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
    return out.withColumn("pass_rate", F.try_divide(100.0 * F.col("n_passed"), F.col("total")))


def removal(visits: DataFrame, entity: str, least: int) -> DataFrame:
    """visits (with status) and `fate`: of an entity with a blocked visit, only that goes if `least` others are left, else all of it."""
    state = visits.groupBy(entity).agg(F.bool_or(F.col("status") == "blocked").alias("__hit"), F.count_if(F.col("status") != "blocked").alias("__clean"))
    fate = F.when(~F.col("__hit"), "kept").when(F.col("__clean") < least, "entity_removed").when(F.col("status") == "blocked", "visit_removed").otherwise("kept")
    return visits.join(state, entity).withColumn("fate", fate).drop("__hit", "__clean")


def severity_matrix(checks: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    """A row an entity, a column a check: 1 where it blocks, 0.5 where it warns, 0 where it passes."""
    worst = F.when(F.col("passed"), 0.0).when(F.col("action") == "block", 1.0).otherwise(0.5)
    return checks.groupBy(entity).pivot("check_name", list(names)).agg(F.max(worst))


def issue_rows(checks: DataFrame) -> DataFrame:
    """Failures as text columns, details as JSON (empty without)."""
    return checks.where(~F.col("passed")).withColumn("details", F.when(F.size("details") > 0, F.to_json("details")).otherwise("")).drop("passed")
