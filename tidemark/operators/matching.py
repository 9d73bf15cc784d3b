"""Files found for what is wanted: by exact name, else by the longest known beginning of a name, in folders by preference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import counted, join_checked

EXACT, BEGINS = 0, 1


def name_matches(stem: Column, names: Mapping[str, Sequence[str]]) -> Column:
    """array<struct<category, kind, place>>: the categories whose file the stem may be, with what decides between files of a folder, the smallest first.

    EXACT: the stem is one of the category's names; place is the name's. BEGINS: in any case, it begins with one, and with no longer name of another category; place is the
    longest such name's length, negative. Beginnings are looked up by their text, one lookup for each length that names have, so nothing is compared with all names."""
    known: dict[str, dict[str, int]] = {}
    for category, own in names.items():
        for place, name in enumerate(own):
            known.setdefault(name, {}).setdefault(category, place)
    entry = lambda c, k, p: F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"), F.lit(p).alias("place"))
    whole = F.create_map(*(x for name, own in known.items() for x in (F.lit(name), F.array(*(entry(c, EXACT, p) for c, p in own.items())))))
    low: dict[str, set[str]] = {}
    for category, own in names.items():
        for name in own:
            low.setdefault(name.lower(), set()).add(category)
    begins = F.create_map(*(x for name, own in low.items() for x in (F.lit(name), F.array(*(entry(c, BEGINS, -len(name)) for c in sorted(own))))))
    none = F.array().cast("array<struct<category:string,kind:int,place:int>>")
    lengths = F.array(*(F.lit(n) for n in sorted({len(n) for n in low}, reverse=True)))
    text = F.lower(stem)
    fits = F.flatten(F.transform(lengths, lambda n: F.coalesce(F.try_element_at(begins, F.when(F.length(text) >= n, F.substring(text, F.lit(1), n))), none)))
    longest = F.filter(fits, lambda x: ~F.exists(fits, lambda y: (y["category"] != x["category"]) & (y["place"] < x["place"])))
    return F.concat(F.coalesce(F.try_element_at(whole, stem), none), longest)


def folder_matches(files: DataFrame, names: Mapping[str, Sequence[str]], folder: str = "folder", stem: str = "stem", path: str = "path") -> DataFrame:
    """(folder, category, path, kind): the best file of each folder and category; of equal ones the first path. Files are judged one by one, so a folder of any size is only a minimum."""
    each = files.where(F.col(path).isNotNull()).select(F.col(folder).alias("folder"), F.col(path).alias("path"), F.explode(name_matches(F.col(stem), names)).alias("m"))
    best = each.groupBy("folder", F.col("m.category").alias("category")).agg(F.min(F.struct("m.kind", "m.place", "path")).alias("b"))
    return best.select("folder", "category", "b.path", "b.kind")


def find_files(wanted: DataFrame, files: DataFrame, names: Mapping[str, Sequence[str]], key: str, folders: str, category: str, folder: str = "folder", stem: str = "stem", path: str = "path", ids: str | None = None, parts: str | None = None) -> DataFrame:
    """(key, path, kind, place): for each row of wanted (key, array of folders by preference, category) the best file of the first folder that has one; place is that folder's.

    ids (an array of wanted) and parts (an array of files, such as the parts of a path): rows that found none take the best file, by the same order, of any that has one
    of the ids among its parts; then place is -1. Rows without a file have a null path, and repeated keys are rows of their own; null folders, categories and stems find nothing."""
    best, n = counted(folder_matches(files, names, folder, stem, path), "folder-matches")
    rows = wanted.select(F.monotonically_increasing_id().alias("__row"), key, F.col(folders).alias("__folders"), F.col(category).alias("category"), *([F.col(ids).alias("__ids")] if ids else []))
    rows, _ = counted(rows, "wanted-files")
    tried = rows.select("__row", "category", F.posexplode("__folders").alias("place", "folder"))
    hit = join_checked(tried, best, ["folder", "category"], rows=n).groupBy("__row").agg(F.min_by(F.struct("path", "kind", "place"), "place").alias("f"))
    found, n = counted(hit, "found-files")
    out = join_checked(rows, found, "__row", "left", rows=n)
    if ids and parts:
        anywhere, k = counted(folder_matches(files.select(F.explode(F.array_distinct(parts)).alias("part"), stem, path), names, "part", stem, path), "part-matches")
        lost = out.where("f is null").select("__row", "category", F.explode("__ids").alias("folder"))
        more, k = counted(join_checked(lost, anywhere, ["folder", "category"], rows=k).groupBy("__row").agg(F.min_by(F.struct("path", "kind", F.lit(-1).alias("place")), F.struct("kind", "path")).alias("g")), "files-anywhere")
        out = join_checked(out, more, "__row", "left", rows=k).withColumn("f", F.coalesce("f", "g"))
    return out.select(key, "f.path", "f.kind", "f.place")
