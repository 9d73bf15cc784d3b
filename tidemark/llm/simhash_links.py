"""Groups of fingerprints, and of nodes that share keys, without all pairs of a group; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, join_checked, staged
from .components import components

#: Parts (lowest bit, width) of a 32-bit segment. Of five, three differing bits leave two untouched.
PARTS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))

#: Shared keys, a number each, that are sent to every executor at most.
SHARED_KEYS = 2_000_000

#: Nodes of a key's largest component that its other rows are compared with before all pairs that are left.
LEADS = 4


def shuffled(exploded: DataFrame) -> DataFrame:
    """A table whose joins shuffle. Spark takes rows made by explode for as small as the file they are made from, and would send many times that through the driver."""
    return exploded.hint("merge")


def distance(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two fingerprints."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def one_bit_more(value: Column, number: Column, width: int) -> Column:
    unset = F.filter(F.array(*(F.lit(1 << i) for i in range(width))), lambda bit: value.bitwiseAND(bit) == 0)
    return F.transform(unset, lambda bit: number.bitwiseOR(value).bitwiseOR(bit))


def segment_keys(words: int, width: int) -> tuple[Column, Column]:
    """(keys under which a fingerprint is stored, keys under which it is looked up as well).

    Each 64-bit word has two segments of `width` bits. A fingerprint is stored under the value of each segment, and
    looked up under that and under each value with one more bit set: of two values that differ in one bit,
    the one without it finds the other, so each pair of the ball of radius one is met once."""
    own, others = [], []
    for w in range(words):
        for half in (0, 1):
            value = F.shiftrightunsigned(F.col(f"f{w}"), 32 * half).bitwiseAND(F.lit((1 << width) - 1))
            number = F.lit((2 * w + half) << 32)
            own.append(number.bitwiseOR(value))
            others.append(one_bit_more(value, number, width))
    return F.array(*own), F.flatten(F.array(*others))


def other_parts(key: Column, print_: Column) -> Column:
    """For a key of a fingerprint of one word in two segments of 32 bits: each two PARTS of the other segment.

    Two fingerprints with at most three differing bits that meet under a key share one of the ten."""
    other = F.when(F.shiftrightunsigned(key, 32) == 0, F.shiftrightunsigned(print_, 32)).otherwise(print_.bitwiseAND(F.lit((1 << 32) - 1)))
    part = [F.shiftrightunsigned(other, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in PARTS]
    return F.array(*(F.lit(i << 16).bitwiseOR(F.shiftleft(part[a], 7)).bitwiseOR(part[b]) for i, (a, b) in enumerate(combinations(range(len(PARTS)), 2))))


def apart_rows(hits: DataFrame, comp: DataFrame, stored: Column) -> tuple[DataFrame, int]:
    """hits with `component` and `rest`, whether a row is outside its key's largest component, of the keys in which rows of different components meet, one of them stored."""
    shared = hits.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("stored", stored)
    count = shared.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("stored").alias("any"))
    mixed = count.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"), F.max("any").alias("any")).where("kinds > 1 and any").select("key", "main")
    return counted(shared.join(mixed, "key").withColumn("rest", F.col("component") != F.col("main")).drop("main"), "links-apart")


def either(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def met(left: DataFrame, on: list[str], names: list[str], condition: Column) -> DataFrame:
    """Rows of left beside the stored ones (their columns after y_) that share `on`: each row of the rest with all, each other one with the rest only."""
    left = shuffled(left)
    y = left.where("stored").select(*on, *(F.col(n).alias(f"y_{n}") for n in (*names, "rest")))
    return left.where("rest").join(y, on).where(condition).unionByName(left.where("not rest").join(y.where("y_rest"), on).where(condition))


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp (node, component) after edges (a, b) between its components, or nodes that it lacks, are added."""
    more = components(edges)
    up = more.select(F.col("node").alias("component"), F.col("component").alias("above"))
    every = comp.unionByName(more.select("node", F.col("node").alias("component")))
    return staged(every.join(up, "component", "left").groupBy("node").agg(F.min(F.coalesce("above", "component")).alias("component")), "merged")


def fingerprint_groups(nodes: DataFrame, words: int = 1, width: int = 32, most: int = 3, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component): for each node that is linked, the smallest node that it reaches; nodes (node, f0, ...) are different fingerprints, or with verify different texts.

    Two are linked if they share a segment up to one bit and differ in `most` bits or fewer in all. A segment's value that many have isn't expanded into
    pairs: first all its rows are compared with its smallest node, which leaves dense groups connected; then only
    rows of different components are compared, with words of 64 bits and three bits only those that share two parts of the other segment as well.
    verify, if given, keeps the rows of (a, b) that are links; fingerprints alone make candidates then."""
    prints = [f"f{w}" for w in range(words)]
    own, others = segment_keys(words, width)
    stored = nodes.select("node", *prints, F.explode(own).alias("key"))
    lead = stored.groupBy("key").agg(F.min(F.struct("node", *prints)).alias("lead"), F.count("*").alias("held"))
    rows = stored.withColumn("stored", F.lit(True)).unionByName(nodes.select("node", *prints, F.explode(others).alias("key")).withColumn("stored", F.lit(False)))
    hits = staged(shuffled(rows).join(lead, "key").where(F.col("node") != F.col("lead.node")), "simhash-hits")
    near = distance([F.col(f) for f in prints], [F.col(f"lead.{f}") for f in prints]) <= most
    pairs = hits.where(near).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    comp = components(verify(pairs.select(*either("a", "b")).distinct()) if verify else pairs)
    left, n = apart_rows(hits.where("held > 1").select("node", *prints, "key", "stored"), comp, F.col("stored"))
    if not n:
        return comp
    on = ["key"]
    if words == 1 and width == 32 and most <= 3:
        left, on = left.withColumn("part", F.explode(other_parts(F.col("key"), F.col("f0")))), ["key", "part"]
    apart = distance([F.col(f) for f in prints], [F.col(f"y_{f}") for f in prints]) <= most
    pairs = met(left, on, ["node", *prints, "component"], (F.col("component") != F.col("y_component")) & apart)
    if verify:
        return linked(comp, verify(pairs.select(*either("node", "y_node")).distinct()))
    return merged(comp, pairs.select(F.col("component").alias("a"), F.col("y_component").alias("b")))


def unlinked(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) that comp (node, component) doesn't have in one component."""
    for x in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_group")), x, "left")
    return pairs.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")


def linked(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """comp (node, component) after the nodes of pairs (a, b) are linked."""
    for x in ("a", "b"):
        pairs = pairs.join(comp.withColumnRenamed("node", x), x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
    return merged(comp, pairs)


def key_groups(nodes: DataFrame, alike: float, verify: Callable[[DataFrame], DataFrame], apart: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, component): for each node that is linked, the smallest node that it reaches, from nodes (node, size, keys).

    Nodes that share a key are candidates if the smaller has at least `alike` times the other's size, and verify keeps some rows of (a, b). As above, a
    key's rows are first compared with its smallest node. Those outside its largest component are compared with LEADS of that one's nodes, drawn by
    hash, which links most of a group of near copies of which many are not like the first; then those still apart with all of other components.
    apart, if given, makes the pairs (a, b) of this last step from the nodes (node, component, rest) that are still apart in a key; it must give all that verify would keep
    between different components, one of the rest. known (node, component), if given, are links found before; pairs within one of its components aren't verified again."""
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared, n = counted(rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key"), "keys-shared")
    hits = staged(join_checked(rows if n <= SHARED_KEYS else shuffled(rows), shared, "key", most=SHARED_KEYS, rows=n), "keys-hits")
    lead = hits.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"), F.count("*").alias("held"))
    led = staged(hits.join(lead, "key").where("node <> lead.node"), "keys-led")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * alike
    pairs = led.where(fits(F.col("size"), F.col("lead.size"))).select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    comp = components(verify(pairs)) if known is None else linked(known, verify(unlinked(known, pairs)))
    left, n = apart_rows(led.where("held > 2").select("node", "size", "key"), comp, F.lit(True))
    if not n:
        return comp
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("o"), "node", "size")) for j in range(LEADS)]
    leads = left.where("not rest").groupBy("key").agg(F.array(*drawn).alias("leads"))
    near = left.where("rest").join(leads, "key").select("node", "size", F.explode("leads").alias("lead")).where(fits(F.col("size"), F.col("lead.size")))
    comp = linked(comp, verify(near.select(*either("node", "lead.node")).distinct()))
    left, n = apart_rows(left.select("node", "size", "key"), comp, F.lit(True))
    if not n:
        return comp
    if apart:
        return linked(comp, verify(apart(staged(left.groupBy("node", "component").agg(F.max("rest").alias("rest")), "nodes-apart"))))
    names, may = ["node", "size", "component"], (F.col("component") != F.col("y_component")) & fits(F.col("size"), F.col("y_size"))
    own = left.groupBy("node").agg(F.collect_set("key").alias("keys"))
    left = left.join(own, "node")
    y = left.select("key", *(F.col(n).alias(f"y_{n}") for n in (*names, "keys", "rest")))
    once = (~F.col("y_rest") | (F.col("node") < F.col("y_node"))) & (F.array_min(F.array_intersect("keys", "y_keys")) == F.col("key"))  # under the least key that both have
    pairs = left.where("rest").join(y, "key").where(may & once)
    return linked(comp, verify(pairs.select(*either("node", "y_node"))))
