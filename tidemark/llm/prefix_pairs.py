"""Pairs of sets that may be alike, exactly: their rarest elements first, cut where no pair can be alike any more. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, join_checked, staged

#: Sizes of sets are dealt into bands of this ratio.
BAND = 1.05


def set_pairs(nodes: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """(a, b) for nodes (node, component, rest) with sets (node, held): each two of different components, one of the rest at least, that may have a similarity (Jaccard) of `alike`; none that has it is left out.

    Elements are ordered by how many of the sets hold them, the rarest first. Of two sets of x and y elements that are alike, alike / (1 + alike) * (x + y) are shared, so the first
    one that they share stands among the first x + 1 less that many, and so many are left from there on in both. Each set is stored under these first elements, for each
    band of sizes that a partner may have. Copies of one text with edits of their own hold these edits first, and meet only where edits are so few that they
    may be alike. An element of one set only moves the others back. Nodes without a row in sets have no pairs; an empty table gives none."""
    least, reach = alike / (1 + alike), math.ceil(math.log(1 / alike) / math.log(BAND)) + 1
    each = sets.select("node", F.size("held").alias("size"), F.explode("held").alias("h"))
    common, n = counted(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "set-elements")
    ordered = join_checked(each, common, "h", rows=n).groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))  # a document's own elements
    lone = F.col("size") - F.size("shared")
    ordered = ordered.where(F.size("shared") >= F.col("size") * alike)
    band = F.floor(F.log("size") / math.log(BAND)).cast("int")
    smallest = lambda b: F.greatest(F.pow(F.lit(BAND), b) - 1e-6, F.col("size") * alike)  # noqa: E731  of a partner in band b
    upto = lambda b: F.greatest(F.floor(F.col("size") - least * (F.col("size") + smallest(b)) + 1e-6) + 1 - lone, F.lit(0)).cast("int")
    first = F.flatten(F.transform(F.sequence(band - reach, band + reach), lambda b: F.transform(
        F.slice("shared", 1, upto(b)), lambda s, i: F.struct(b.alias("partner"), s["h"].alias("h"), (F.col("size") - lone - i).alias("left")))))
    rows = ordered.join(nodes, "node").select("node", "size", "component", "rest", band.alias("band"), F.explode(first).alias("e")).select("*", "e.*").drop("e")
    rows = staged(rows, "set-prefixes")
    x = rows.where("rest")
    y = rows.select(*(F.col(c).alias(f"y_{c}") for c in ("node", "size", "component", "rest", "left")), "h", F.col("band").alias("partner"), F.col("partner").alias("band"))
    size, other = F.col("size"), F.col("y_size")
    may = (F.col("component") != F.col("y_component")) & (F.least(size, other) >= F.greatest(size, other) * alike) & (F.least("left", "y_left") + 1e-6 >= least * (size + other))
    once = ~F.col("y_rest") | (F.col("node") < F.col("y_node"))
    return x.join(y, ["h", "band", "partner"]).where(may & once).select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")).distinct()
