"""Connected components of an edge table, by repeated contraction; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, staged

#: Edges up to which a round sends its hooks to every executor instead of shuffling, and the tasks that such a round's tables have.
SMALL, SMALL_TASKS = 50_000, 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that it reaches.

    Each round, every node hooks to the first of its neighbours and itself, hooks are followed twice more and the edges are
    rewritten between the nodes they lead to, until none is left. Rounds take the nodes by turns in their own order, in which a star
    around its smallest node ends at once, and in a hashed one, in which long chains shrink to less than
    half, so some log n rounds do. Neighbours are reduced by a min with map-side partial results, so a node
    with a third of all edges is no single task's work. A round writes its hooks and its edges, counted as they are written; one over
    SMALL edges or fewer joins without a shuffle. Tables in the shared folder cut the lineage. Self-loops, repeated and reversed
    edges are allowed; an edge with a null end is ignored; an empty table gives an empty result."""
    kind = edges.schema[a].dataType.simpleString()
    live, n = counted(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") < F.col("b")))
        .distinct(), "edges")
    hops = []
    while n:
        small = n <= SMALL
        sent = F.broadcast if small else (lambda df: df)  # a row for each end of at most SMALL edges
        fit = (lambda df: df.coalesce(SMALL_TASKS)) if small else (lambda df: df)
        turn = len(hops)
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")
        first = live.select(ends).select("e.*").groupBy("node").agg(F.min(F.struct(order("to").alias("o"), "to")).alias("best"))
        hook = staged(fit(first.select("node", F.when(F.col("best.o") < order("node"), F.col("best.to")).otherwise(F.col("node")).alias("to"))), "hooks")
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("above"))
        hop = hook
        for _ in range(2):
            hop = hop.join(sent(up), "to").select("node", F.col("above").alias("to"))
        hop = hop if small else staged(hop, "hops")
        a2, b2 = (hop.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in ("a", "b"))
        moved = live.join(sent(a2), "a").join(sent(b2), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        live, n = counted(fit(moved.distinct()), "edges")
        hops.append((hop, sent))
    if not hops:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    label = hops[0][0].withColumnRenamed("to", "root")
    for hop, sent in hops[1:]:
        up = hop.select(F.col("node").alias("root"), F.col("to").alias("above"))
        label = label.join(sent(up), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    few = hops[0][1] is F.broadcast
    label = staged(label.coalesce(SMALL_TASKS) if few else label, "labels")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return staged(label.join(F.broadcast(least) if few else least, "root").select("node", "component"), "components")
