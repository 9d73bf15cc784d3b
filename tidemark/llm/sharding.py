"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, staged

#: Places on the ring, and rows that share one task's sort at most, about.
PLACES, RUN_ROWS = 1 << 16, 20_000


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node in order of place, by a hash of its shard and number; a place has one node."""
    if shards * virtual > PLACES:
        raise ValueError(f"{shards * virtual} virtual nodes have no room on {PLACES} places")
    nodes: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual):
            place = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little") % PLACES
            while place in nodes:
                place = (place + 1) % PLACES
            nodes[place] = s
    return sorted(nodes.items())


def spill(nodes: list[tuple[int, int]], loads: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(node, first, end, shard): stretches of each node's rows and the shard that takes them.

    loads: rows that hash to each node; room: rows that each shard may hold, together all rows. Rows stay
    with their node's shard while it has room, nodes in order of the ring; what is over continues clockwise, all nodes
    one step at a time, to the next shard with room. Numbers of rows are all it takes: the size of the ring, not of the data."""
    room = list(room)
    out, over = [], []
    for i, n in enumerate(loads):
        if take := min(n, room[nodes[i][1]]):
            out.append((i, 0, take, nodes[i][1]))
            room[nodes[i][1]] -= take
        if n > take:
            over.append([i, take, n, i])
    while over:
        rest = []
        for i, first, end, at in over:
            at = (at + 1) % len(nodes)
            while not room[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            if take := min(end - first, room[nodes[at][1]]):
                out.append((i, first, first + take, nodes[at][1]))
                room[nodes[at][1]] -= take
            if end - first > take:
                rest.append([i, first + take, end, at])
            if not any(room):
                break
        over = rest
    return out


def shard(docs: DataFrame, shards: int = 24, virtual: int = 256, size: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    Each id hashes to a place of the ring and belongs to the next virtual node clockwise. A shard holds its even
    share of the rows, the remainder going to the lowest shards, so counts are at most one apart (the law `rows`); rows beyond that
    continue clockwise to the next shard with room. Only overflowing rows leave the shard of their
    own node, so a changed number of shards moves little more than its share.

    A row's rank among its node's rows decides which stretch it belongs to. Nodes are cut by a second hash into
    runs of some RUN_ROWS rows; a run is what one task sorts, and the runs' counts give the ranks between them. The
    driver sees one count for each virtual node. slot counts a shard's rows from 0 without gaps.

    A null text has no bytes (size 8, the checksum of nothing); a null id hashes as a value of its own; equal
    rows and ties keep a row each, in order of hash, id and text checksum; an empty table gives no rows; other columns are ignored."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.octet_length(body) + 8).cast("long") if size is None else size
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(F.lit("place"), F.col(key)).alias("hash"))
    rows = staged(rows.withColumn("place", F.pmod("hash", F.lit(PLACES)).cast("int")), "shard-rows")
    nodes = ring(shards, virtual)
    places = [p for p, _ in nodes]
    spark = docs.sparkSession
    owner = spark.createDataFrame([(p, bisect.bisect_left(places, p) % len(nodes)) for p in range(PLACES)], "place int, node int").coalesce(1)  # the ring's size, whatever the data's
    n = rows.count()
    runs = max(1, -(-n // (RUN_ROWS * len(nodes))))
    placed = rows.join(F.broadcast(owner), "place").withColumn("run", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(runs)).cast("int"))
    counts = staged(placed.groupBy("node", "run").agg(F.count("*").alias("n")), "shard-runs")
    loads = [0] * len(nodes)
    for r in counts.groupBy("node").agg(F.sum("n").alias("n")).collect():
        loads[r.node] = r.n
    plan, filled = [], [0] * shards
    for node, first, end, s in spill(nodes, loads, [n // shards + (s < n % shards) for s in range(shards)]):
        plan.append((node, first, end, s, filled[s] - first))
        filled[s] += end - first
    plan = spark.createDataFrame(plan, "node int, first long, end long, shard int, shift long").coalesce(1)  # a row a node and a few for each full shard
    before = Window.partitionBy("node").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("node", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("node", "run").orderBy("hash", "doc_id", "text_crc32", "size")
    ranked = join_checked(placed.withColumn("rank", F.row_number().over(order) - 1), staged(offsets, "shard-offsets"), ["node", "run"]).withColumn("rank", F.col("rank") + F.col("offset"))
    dealt = ranked.join(F.broadcast(plan), "node").where("rank >= first and rank < end")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
