"""Column builders: identifiers, categories, lenient parsing, classification. Each takes and returns columns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A file-name glob as a regular expression that both Java and RE2 read."""
    out = []
    for part in re.split(r"(\[[^\]]+\]|\*|\?)", pattern):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part.startswith("[") and part.endswith("]") and len(part) > 2:
            out.append(f"[{'^' if part[1] == '!' else ''}{re.escape(part[1:-1].lstrip('!'))}]")
        else:
            out.append(re.escape(part))
    return f"^{''.join(out)}$"


def exclusion_reason(name: Column, patterns: Sequence[str]) -> Column:
    """The first pattern that matches, as a reason; null if none does."""
    return F.coalesce(*(F.when(name.rlike(glob_regex(p)), F.lit(f"Matched exclusion pattern: {p}")) for p in patterns), F.lit(None))


def matches(name: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(name, pattern)


def normalize_id(raw: Column, prefix: str = "P") -> Column:
    """prefix and the number without leading zeros; nothing left counts as 0."""
    bare = F.ltrim(F.regexp_replace(F.trim(raw), f"^[{prefix.lower()}{prefix.upper()}]", ""), F.lit("0"))
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(bare, F.lit("")), F.lit("0")))


def name_number(text: Column, numbers: Mapping[str, int]) -> Column:
    """The number of a name in any case; null if it isn't known."""
    known = F.create_map(*(F.lit(x) for name, n in numbers.items() for x in (name.lower(), n)))
    return F.try_element_at(known, F.lower(F.trim(text)))


def tolerant_id(raw: Column, known: Column, prefix: str = "P") -> Column:
    """A known original id first; else the normalised number, or the prefixed text where it is none."""
    digits = F.regexp_replace(F.trim(raw), f"^[{prefix.lower()}{prefix.upper()}]", "")
    return F.coalesce(known, F.concat(F.lit(prefix), F.coalesce(digits.try_cast("bigint").cast("string"), digits)))


def first_synonym(text: Column, synonyms: Mapping[str, Sequence[str]], otherwise: Column | None = None) -> Column:
    """The standard name of the first synonym, in the mapping's order, that the text contains in any case."""
    low = F.lower(text)
    found = F.coalesce(*(F.when(low.contains(s.lower()), F.lit(name)) for name, group in synonyms.items() for s in group), F.lit(None))
    return F.coalesce(found, text if otherwise is None else otherwise)


def resolve_category(text: Column, names: Sequence[str], synonyms: Mapping[str, str]) -> Column:
    """An exact name, else an exact synonym's name, else the longest name that the text starts with."""
    exact = F.coalesce(*(F.when(text == n, F.lit(n)) for n in names), F.lit(None))
    same = F.coalesce(*(F.when(text == s, F.lit(n)) for s, n in synonyms.items()), F.lit(None))
    start = F.coalesce(*(F.when(text.startswith(n), F.lit(n)) for n in sorted(names, key=len, reverse=True)), F.lit(None))
    return F.coalesce(exact, same, start)


def normalize_text(text: Column) -> Column:
    """Lower case, one space for each run of white space and no-break spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), r"\s+", " ")))


def is_zero_or_none(value: Column) -> Column:
    """Null, 0 and the text "0"; the text "0.0" is a value."""
    return value.isNull() | (value.cast("string") == "0")


def lenient_int(text: Column) -> Column:
    """The first of a comma list, cut towards zero; null if it is no number."""
    return F.split(text, ",")[0].try_cast("double").try_cast("int")


def lenient_double(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def first_number(text: Column, patterns: Sequence[str]) -> Column:
    """The number that the first matching pattern captures."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns))


def classify(text: Column, rules: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The label of the first rule (part of the text, label) that holds."""
    out = None
    for part, label in rules:
        out = F.when(text.contains(part), label) if out is None else out.when(text.contains(part), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def suffix_number(text: Column, separator: str = "-", least_parts: int = 3) -> Column:
    """The number after the last separator; -1 with fewer parts or without a number."""
    parts = F.split(text, re.escape(separator))
    return F.when(F.size(parts) < least_parts, -1).otherwise(F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(-1)))


def priority_pick(priority: str, available: Column) -> Column:
    """The first of "a > b > c" that the array holds; null if none."""
    wanted = F.array(*map(F.lit, re.split(r"\s*>\s*", priority.strip())))
    return F.get(F.filter(wanted, lambda x: F.array_contains(available, x)), 0)


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def effect_size(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def safe_round(value: Column, digits: int = 2) -> Column:
    """Rounded half to even; NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(F.bround(value, digits))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%.1fs", seconds)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def laterality(x: Column, left: float = 115, right: float = 125) -> Column:
    return F.when(x < left, "left").when(x > right, "right").otherwise("midline")


def unit_interval(value: Column, low: float | None, high: float | None) -> Column:
    """Where the value lies between low and high, cut to [0, 1]; without bounds log1p of it over 5."""
    scaled = F.log1p(F.greatest(value, F.lit(0.0))) / 5 if low is None else (value - low) / (high - low)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def shape_issues(actual: Column, expected: Sequence[int], tolerance: int) -> Column:
    """Axes of an array of sizes that are further than tolerance from the expected ones, as texts."""
    wanted = F.array(*map(F.lit, expected))
    said = F.zip_with(actual, wanted, lambda a, e: F.when(F.abs(a - e) > tolerance, F.format_string("%d != %d", a, e)))
    return F.filter(said, lambda x: x.isNotNull())


def spacing_strategy(current: Column, target: Column, most_interpolated: float = 1.2, most_learned: float = 5.0) -> Column:
    """For each axis how to get from the current to the target spacing."""

    def one(c: Column, t: Column) -> Column:
        return F.when(c <= t, "interpolate").when(c <= most_interpolated, "interpolate").when(c <= most_learned, "learned").otherwise("interpolate_then_learned")

    return F.zip_with(current, target, one)


def relative_thickness(spacing: Column) -> Column:
    """The largest spacing over the smallest of the other two."""
    ordered = F.array_sort(spacing)
    return F.try_divide(F.element_at(ordered, -1), F.element_at(ordered, 1))


def step_base(name: Column, known: Sequence[str]) -> Column:
    """The first known step, more particular ones first, that the name contains; else the name."""
    return F.coalesce(*(F.when(name.contains(k), F.lit(k)) for k in sorted(known, key=len, reverse=True)), name)
