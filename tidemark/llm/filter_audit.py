"""Filter interaction audit: documents counted on the edges of the lattice of filter sets, every order a path over them."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, counted, join_checked, staged

#: Filters of an audit at most: the orders are sent to every executor, 7 filters have 35,280 steps.
MOST_FILTERS = 7


def text_conditions(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides, each true where it fails: few words (A), repeated words (B), capitals (C), symbols (D)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * different < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_copies(rows: DataFrame, digest: str, key: str, name: str) -> DataFrame:
    """rows with the flag `name`: the same digest is found under a smaller key. A null key is no smaller one and has none."""
    first, n = counted(rows.groupBy(digest).agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null").select(digest, "__first"), "first-copies")
    return join_checked(rows, first, digest, "left", rows=n).withColumn(name, F.coalesce(F.col(key) > F.col("__first"), F.lit(False))).drop("__first")


def lattice_paths(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, step, applied, bit): each order of the filters, a row an edge that it passes over."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    rows = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[g] for g in order), step, applied, 1 << f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, bit int")


def edge_counts(classes: DataFrame, filters: str) -> DataFrame:
    """(part, applied, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of classes (part, failing, n, good, toxic): what a filter does after a set of others.

    A document meets every edge; documents of a part that fail the same filters do the same on all edges, so they come counted already."""
    n = len(filters)
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("bit")) for s in range(1 << n) for f in range(n) if not s >> f & 1))
    met = classes.select("*", F.explode(edges).alias("e")).select("*", "e.*")
    fails, gone = F.col("failing").bitwiseAND(F.col("bit")) != 0, F.col("failing").bitwiseAND(F.col("applied")) != 0
    of = lambda condition, what="n": F.coalesce(F.sum(F.when(condition, F.col(what))), F.lit(0))
    return met.groupBy("part", "applied", "bit").agg(
        of(~fails & ~gone).alias("kept"), of(fails & ~gone).alias("removed"), of(fails & gone).alias("redundant"), of(F.col("failing") == F.col("bit")).alias("unique_fails"),
        of(fails & ~gone, "good").alias("good_lost"), of(fails & ~gone, "toxic").alias("toxic_lost"))


def with_shares(edges: DataFrame, filters: str) -> DataFrame:
    """edges with `shapley`: what the edge's filter removes in all orders together; an edge lies on |before|! * |after|! of them."""
    n = len(filters)
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("applied") + 1)
    total = edges.groupBy("part", "bit").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return edges.join(total, ["part", "bit"])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order of the five filters and step.

    A to D are text_conditions, E fails where a smaller key has the same text. The texts are read once, to a few bits and a digest a document; these are counted by part and
    failing filters before anything else moves, so no part or text, however common, is one task's work. Edges come from the counts and the orders are joined to the edges.

    Null text is empty; a null part is the empty string; rows that repeat, and rows without a key, count as documents each, the latter without labels and never as a later copy; of several
    labels of a key the largest holds; empty docs have no part, so no rows; other columns are ignored."""
    spark, filters = docs.sparkSession, "ABCDE"
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(text_conditions(F.col("__text")).values())), F.lit(0))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), words.alias("__text"))
    judged = staged(own.select("doc_id", "part", bits.alias("failing"), F.unhex(F.sha2("__text", 256)).alias("digest")), "judged-filters")
    judged = with_copies(judged, "digest", "doc_id", "copy").select("doc_id", "part", (F.col("failing") + F.when(F.col("copy"), 1 << 4).otherwise(0)).alias("failing"))
    known = labels.select(F.col(key).cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known, n = counted(known.where("doc_id is not null and (good or toxic)"), "audit-labels")
    marked = join_checked(judged, known, "doc_id", "left", rows=n)
    classes = marked.groupBy("part", "failing").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    edges = with_shares(staged(edge_counts(classes, filters), "lattice-edges"), filters)
    paths = lattice_paths(spark, filters)
    out = edges.join(F.broadcast(paths), ["applied", "bit"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
