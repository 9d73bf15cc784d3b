"""The steps of a cohort from the command line: python -m tidemark STEP ... Each reads and writes tables; nothing is changed in place."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import curation as C
from tidemark.operators import statistics as S
from tidemark.sources import layouts as Y
from tidemark.sources.staging import staged
from tidemark.sources.tables import append_ledger, catalog, id_map_json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    steps = out.add_subparsers(dest="step", required=True)

    def step(name: str, about: str) -> argparse.ArgumentParser:
        p = steps.add_parser(name, help=about, description=about)
        p.add_argument("--out", required=True, help="folder for what the step returns")
        p.add_argument("--dry-run", action="store_true", help="say how many rows there would be, write nothing")
        return p

    p = step("reorganize", "Scan folders by layouts: OUT/items (Parquet), OUT/rejected (CSV ledger).")
    p.add_argument("root")
    p.add_argument("--config", required=True, help='JSON: {"layouts": [{"source", "pattern", "study", "named"}], "studies": {name: number}, "exclusions": [glob]}')
    p.add_argument("--format", choices=sorted(Y.FORMATS), default="nrrd")
    p = step("filter", "Keep visits that hold the required items, of entities with enough of them: OUT/kept, OUT/rejected.")
    p.add_argument("items", help="Parquet of items")
    p.add_argument("--entity", default="patient_id")
    p.add_argument("--visit", default="study_number")
    p.add_argument("--item", default="sequence")
    p.add_argument("--require", nargs="+", required=True)
    p.add_argument("--missing", type=int, default=0, help="required items that a visit may lack")
    p.add_argument("--least", type=int, default=2, help="good visits of an entity")
    p = step("analyze", "Median, MAD and outliers of values by group: OUT/summary, OUT/outliers.")
    p.add_argument("rows", help="Parquet of values")
    p.add_argument("--by", nargs="+", required=True)
    p.add_argument("--value", required=True)
    p.add_argument("--most", type=float, default=3.5, help="modified z from which a value is an outlier")
    p = step("curate", "New numbers without gaps for entities and visits: OUT/ids (Parquet), OUT/id_mapping (JSON lines).")
    p.add_argument("visits", help="Parquet of kept visits")
    p.add_argument("--entity", default="patient_id")
    p.add_argument("--visit", default="study_number")
    p.add_argument("--name", required=True, help="first part of new ids")
    p = step("query", "A registered query over a folder of tables: OUT (Parquet).")
    p.add_argument("name")
    p.add_argument("tables")
    return out


def reorganize(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    with open(a.config) as f:
        config = json.load(f)
    scanned = Y.scan_layouts(catalog(spark, a.root), [Y.Layout(**x) for x in config["layouts"]], config.get("studies", {}), config.get("exclusions", []), Y.FORMATS[a.format])
    scanned = scanned if a.dry_run else staged(scanned, "scan")
    return {"items": Y.kept(scanned), "rejected": Y.rejected(scanned)}


def filtered(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    whole = C.completeness(spark.read.parquet(a.items), a.entity, a.visit, a.item, a.require, a.missing)
    judged = C.cascade(whole, a.entity, a.visit, F.col("complete"), a.least)
    judged = judged if a.dry_run else staged(judged, "judged")
    alone = F.col("fate") == "visit_rejected"
    reason = F.when(alone, F.concat(F.lit("missing "), "missing")).otherwise("too few visits")
    gone = judged.where("fate <> 'kept'").select(F.lit(None).cast("string").alias("source_path"), F.lit("").alias("filename"), F.col(a.entity).cast("string").alias("patient_id"), F.col(a.visit).cast("string").alias("study_name"), reason.alias("rejection_reason"), F.lit("filtering").alias("source_type"), F.when(alone, 1).otherwise(2).alias("stage"))
    return {"kept": judged.where("fate = 'kept'").select(a.entity, a.visit), "rejected": gone}


def analyzed(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    rows = spark.read.parquet(a.rows)
    return {"summary": S.group_summary(rows, a.by, a.value, a.most), "outliers": S.mad_outliers(rows, a.by, a.value, a.most).where("outlier")}


def curated(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    ids = C.renumber(spark.read.parquet(a.visits), a.entity, a.visit, a.name)
    named = ids.select(F.col(a.entity).cast("string").alias("old_entity"), F.col(a.visit).cast("string").alias("old_visit"), "new_entity", "new_visit")
    return {"ids": ids, "id_mapping": id_map_json(named)}


def queried(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    from tidemark.plans.queries import QUERIES

    if a.name not in QUERIES:
        raise SystemExit(f"no query {a.name}; there are: {', '.join(sorted(QUERIES))}")
    return {"": QUERIES[a.name](spark, a.tables)}


STEPS = {"reorganize": reorganize, "filter": filtered, "analyze": analyzed, "curate": curated, "query": queried}


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    """Runs a step; the rows of each table that it returns, written (rejected rows as a CSV ledger, id_mapping as text, all else as Parquet) or only counted."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    said = {}
    for name, df in STEPS[a.step](spark, a).items():
        at = f"{a.out.rstrip('/')}/{name}".rstrip("/")
        if a.dry_run:
            said[name or a.step] = df.count()
            continue
        if name == "rejected":
            append_ledger(df, at)
        elif name == "id_mapping":
            df.write.mode("errorifexists").text(at)
        else:
            df.write.mode("errorifexists").parquet(at)
        said[name or a.step] = spark.read.text(at).count() if name == "id_mapping" else spark.read.option("header", True).option("multiLine", True).csv(at).count() if name == "rejected" else spark.read.parquet(at).count()
    for name, n in said.items():
        print(f"{name}: {n} rows" + " (not written)" * a.dry_run)
    return said


if __name__ == "__main__":
    main()
