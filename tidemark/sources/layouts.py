"""Folder layouts as patterns: each path is parsed once into one table of what is kept and what is rejected, with its reason."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import exclusion_reason, name_number, normalize_id

FIELDS = ("patient", "study", "modality")
#: Endings of image files by format, the more particular first.
FORMATS = {"nrrd": (".nrrd",), "nifti": (".nii.gz", ".nii"), "auto": (".nrrd", ".nii.gz", ".nii")}


@dataclass(frozen=True)
class Layout:
    """Where a source's files are: a pattern such as "source/RM/{modality}/{patient}/{file}", matched at the end of a path.

    {patient}, {study}, {modality} and {file} are fields, {anything else} is any text; none goes over a slash. study: the number of all files of a layout without {study}, and
    named its name in the ledger."""

    source: str
    pattern: str
    study: str | None = None
    named: str | None = None

    def parts(self) -> list[str]:
        return re.findall(r"\{(\w+)\}", self.pattern)

    def regex(self) -> str:
        """The pattern as a regular expression that Java and RE2 both read, with a group for each field in order."""
        pieces = re.split(r"\{\w+\}", self.pattern)
        return f"(?:^|/){'([^/]+)'.join(re.escape(p) for p in pieces)}$"


def ending(path: Column, endings: Sequence[str]) -> Column:
    """The first of the endings that a path has; null if none."""
    return F.coalesce(*(F.when(F.endswith(path, F.lit(e)), F.lit(e)) for e in endings), F.lit(None).cast("string"))


def parsed(paths: DataFrame, layouts: Sequence[Layout], path: str = "path") -> DataFrame:
    """paths with `layout`, an array of a layout's source, study and name and the path's fields, of the first layout that it fits; null if it fits none."""
    column = F.col(path)

    def fields(x: Layout) -> Column:
        names = x.parts()
        found = lambda n: F.regexp_extract(column, x.regex(), names.index(n) + 1) if n in names else F.lit(None).cast("string")
        return F.struct(F.lit(x.source).alias("source"), F.lit(x.study).cast("string").alias("study_number"), F.lit(x.named).cast("string").alias("named"), *(found(n).alias(n) for n in (*FIELDS, "file")))

    return paths.withColumn("layout", F.coalesce(*(F.when(column.rlike(x.regex()), fields(x)) for x in layouts)))


def scan_layouts(
    paths: DataFrame, layouts: Sequence[Layout], studies: Mapping[str, int], exclusions: Sequence[str] = (), endings: Sequence[str] | None = FORMATS["nrrd"], path: str = "path", prefix: str = "P",
) -> DataFrame:
    """(path, filename, sequence, source_type, patient_id, study_name, study_number, modality, rejection_reason) of the paths that have one of the endings (None: of all).

    Each path takes the first layout that it fits. rejection_reason is null for what is kept, else the first that holds: no layout, an unknown study folder, an excluded file name.
    Folders' names are looked up in any case; patients get the prefix and lose leading zeros. Nothing moves: kept and rejected rows are one scan's (kept, rejected). Null paths are left out; repeated ones stay."""
    column = F.col(path)
    end = ending(column, endings) if endings else F.regexp_extract(column, r"(\.nii\.gz|\.[^./]+)?$", 1)
    rows = parsed(paths.where(column.isNotNull()), layouts, path).withColumn("__end", end).where(F.col("__end").isNotNull())
    at = F.col("layout")
    name = F.element_at(F.split(column, "/"), -1)
    number = F.coalesce(at["study_number"], name_number(at["study"], studies).cast("string"))
    reason = F.coalesce(
        F.when(at.isNull(), "No known layout"),
        F.when(number.isNull(), F.concat(F.lit("Unknown study directory name '"), at["study"], F.lit("'"))),
        exclusion_reason(name, exclusions) if exclusions else F.lit(None).cast("string"))
    study_name = F.coalesce(at["named"], F.when(number.isNull(), at["study"]).otherwise(F.lower(at["study"])))
    return rows.select(
        column.alias("path"), name.alias("filename"), F.left(name, F.length(name) - F.length("__end")).alias("sequence"),
        at["source"].alias("source_type"), F.when(at["patient"].isNotNull(), normalize_id(at["patient"], prefix)).alias("patient_id"), study_name.alias("study_name"), number.alias("study_number"), at["modality"].alias("modality"), reason.alias("rejection_reason"))


def kept(scanned: DataFrame) -> DataFrame:
    return scanned.where("rejection_reason is null").drop("rejection_reason")


def rejected(scanned: DataFrame, stage: int = 0) -> DataFrame:
    """The rejected rows in the ledger's columns (LEDGER_SCHEMA)."""
    gone = scanned.where("rejection_reason is not null")
    return gone.select(F.col("path").alias("source_path"), "filename", "patient_id", "study_name", "rejection_reason", "source_type", F.lit(stage).alias("stage"))


def dataset_structure(scanned: DataFrame) -> DataFrame:
    """(patient_id, study_name, sequences, n): what each study holds, sorted, with repeats; studies without files have no row."""
    own = kept(scanned).groupBy("patient_id", "study_name").agg(F.sort_array(F.collect_list("sequence")).alias("sequences"))  # a study's own files
    return own.withColumn("n", F.size("sequences"))


def shape_census(studies: DataFrame, files: DataFrame, expected: Sequence[str], key: Sequence[str], item: str, shape: str) -> DataFrame:
    """(key, item, status, shape): each study of studies (key) by each expected item; MISSING without a file, BROKEN without a shape (array of sizes), else OK.

    Expected cells come of a list that each study's row carries, so the rows are the studies' times the list's. Of several files of a cell the one with the smallest shape counts; repeated studies are one."""
    cells = studies.select(*key).distinct().withColumn(item, F.explode(F.array(*map(F.lit, expected))))
    have = files.where(F.col(item).isin(*expected)).groupBy(*key, item).agg(F.min(shape).alias("shape"))
    found = cells.join(have.withColumn("__there", F.lit(True)), [*key, item], "left")
    return found.select(*key, item, F.when(F.col("__there").isNull(), "MISSING").when(F.col("shape").isNull(), "BROKEN").otherwise("OK").alias("status"), "shape")


def census_summary(census: DataFrame, item: str) -> DataFrame:
    """(item, status, shape, n): how often each item has each shape, MISSING and BROKEN without one."""
    return census.groupBy(item, "status", F.array_join("shape", "x").alias("shape")).agg(F.count("*").alias("n"))
