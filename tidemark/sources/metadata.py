"""Metadata of entities: a JSON map at a file's root, read in parts, and the flat table that goes with it, each giving the other's rows back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends an entry of a map that is written with two spaces a level; a text's own line ends are escaped, so nothing else reads like it.
ENTRY_END = "\n  }"
#: What curation adds to an entity, with its defaults; in files the columns may have other names.
DEFAULTS = {"included": True, "exclusion_reason": None, "assigned_id": None}


def read_root_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, value): the entries of JSON maps, the values as JSON text.

    Files written with an indent of two are split where an entry ends, by Spark's own reader, so a large one is read by many tasks and no row is the whole map. A map
    on one line is one row; lines: each line is a map of its own. Broken texts give no entries."""
    if lines:
        text = F.col("value")
        parts = spark.read.text(path)
    else:
        parts = spark.read.option("lineSep", ENTRY_END).text(path)
        inner = F.regexp_replace(F.regexp_replace("value", r"^[\s,]*\{?[\s,]*", ""), r"[\s,}]*$", "")
        # what was cut off at the end of an entry; entries without anything below them keep their own ends
        depth = F.length(F.regexp_replace(strip_texts(inner), r"[^{]", "")) - F.length(F.regexp_replace(strip_texts(inner), r"[^}]", ""))
        text = F.concat(F.lit("{"), inner, F.repeat(F.lit("}"), F.greatest(depth, F.lit(0)).cast("int")), F.lit("}"))
    return parts.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def strip_texts(json: Column) -> Column:
    """JSON without its texts, so that only its own brackets are left."""
    return F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')


def with_curation(rows: DataFrame, value: str = "value", renamed: dict[str, str] | None = None) -> DataFrame:
    """rows with DEFAULTS' columns out of a value's `_curation`; what it lacks has its default. renamed: columns under another name there."""
    names = {c: (renamed or {}).get(c, c) for c in DEFAULTS}
    found = F.from_json(F.get_json_object(value, "$._curation"), ", ".join(f"`{n}` {'boolean' if c == 'included' else 'string'}" for c, n in names.items()))
    return rows.withColumns({c: F.coalesce(found[names[c]], F.lit(d).cast("boolean" if c == "included" else "string")) for c, d in DEFAULTS.items()})


def metadata_lines(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """`value`: a line of JSON for each entity, {key: {fields, _curation: {...}}}; read_root_map reads them with lines. Nulls have no field."""
    own = F.to_json(F.map_from_entries(F.array(F.struct(F.col(key).cast("string").alias("key"), F.struct(*fields, F.struct(*DEFAULTS).alias("_curation")).alias("value")))))
    return rows.where(F.col(key).isNotNull()).select(own.alias("value"))


def write_enriched_csv(rows: DataFrame, path: str) -> None:
    """The flat table; texts quoted, nulls empty."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_enriched_csv(spark: SparkSession, path: str, casts: dict[str, str], prefix: str = "P", keys: Sequence[str] = ("patient_id", "original_id"), renamed: dict[str, str] | None = None) -> DataFrame:
    """(patient_id, casts' columns, DEFAULTS' columns) of a flat table.

    The id is the first of keys that the table has; ids without the prefix get it, and rows without an id go. A number may be written with decimals ("61.0"), other
    text that the cast can't read is null; a column that the table lacks is null, `included` true. renamed: columns under another name in the table."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = {c: (renamed or {}).get(c, c) for c in (*casts, *DEFAULTS)}
    text = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if names[c] in raw.columns else F.lit(None).cast("string")
    whole = lambda c, kind: text(c).try_cast("double").try_cast(kind) if kind in ("int", "bigint") else text(c).try_cast(kind)
    key = F.nullif(F.trim(F.col(next(k for k in keys if k in raw.columns))), F.lit(""))
    number = text("included").try_cast("double")
    included = F.coalesce(text("included").try_cast("boolean"), number != 0, F.lit(True))
    named = F.when(key.startswith(prefix), key).otherwise(F.concat(F.lit(prefix), key))
    return raw.where(key.isNotNull()).select(named.alias("patient_id"), *(whole(c, k).alias(c) for c, k in casts.items()), included.alias("included"), *(text(c).alias(c) for c in DEFAULTS if c != "included"))
