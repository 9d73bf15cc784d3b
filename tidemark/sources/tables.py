"""Reading and writing tables: parquet folders, ledgers, JSON side inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "source_path string, filename string, patient_id string, study_name string, rejection_reason string, source_type string, stage int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, root: str, pattern: str = "*", depth: int = 3) -> DataFrame:
    """(path, name, stem, ext, length, part_1 ...): the files under root, part_1 being the folder above the file. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"(\.nii\.gz|\.[^.]+)$", 1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"(\.nii\.gz|\.[^.]+)$", "").alias("stem"), ext.alias("ext"), "length", *(F.element_at(parts, -1 - k).alias(f"part_{k}") for k in range(1, depth + 1)))


def by_extension(files: DataFrame, key: list[str], order: tuple[str, ...] = (".nrrd", ".nii.gz", ".nii")) -> DataFrame:
    """One file of each key, the first extension in order that it has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("ext"))
    return files.where(rank > 0).groupBy(*key).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A rejection ledger in CSV; ledgers from before stages were kept have stage 0."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    stage: Column = F.coalesce(F.col("stage").try_cast("int"), F.lit(0)) if "stage" in raw.columns else F.lit(0)
    names = [x.split()[0] for x in LEDGER_SCHEMA.split(", ")][:-1]
    return raw.select(*(F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names), stage.alias("stage"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_id_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(old_entity, new_entity, old_visit, new_visit) out of {old: {new_id, studies: {old: new}}}, one map a file or, with lines, a line."""
    kind = "map<string,struct<new_id:string,studies:map<string,string>>>"
    rows = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", kind)).alias("old_entity", "e"))
    return rows.select("old_entity", F.col("e.new_id").alias("new_entity"), F.explode("e.studies").alias("old_visit", "new_visit"))


def id_map_json(ids: DataFrame) -> DataFrame:
    """`value`, the JSON of one old entity's part of an id map in a row each; read_id_map reads such lines as well as a map in one text."""
    each = ids.groupBy("old_entity", "new_entity").agg(F.map_from_entries(F.collect_list(F.struct("old_visit", "new_visit"))).alias("studies"))  # an entity's own visits
    return each.select(F.to_json(F.map_from_entries(F.array(F.struct("old_entity", F.struct(F.col("new_entity").alias("new_id"), "studies"))))).alias("value"))
