"""Near duplicates by SetSketch registers: bands of register values, a joint estimate by likelihood, then the sets themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, join_checked, staged, with_rows
from .near_dup import SEED, carried, rest_pairs, shingle_hashes, shingle_sets
from .simhash_links import key_groups
from .words import slices

#: Keys of a sketch and registers of each: a pair of similarity 0.8 shares no key with a probability of (1 - 0.8 ** 6) ** 40, 5 in a million.
BANDS, ROWS = 40, 6
#: Registers are 1 - log(x) to this base, rounded down and cut to 0 and MOST, x being the least of exponential numbers of this rate.
BASE, RATE, MOST = 1.001, 20.0, 65_535
#: By how much likelier (in log) the best estimate must be than the threshold for a pair to be left out: a pair that is alike goes with a probability of exp(-SLACK) at most.
SLACK = 14.0
#: Hashes that meet all registers at a time.
CHUNK = 1024


def registers(hashes: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """n registers of a set of 64-bit hashes; zeros for the empty set.

    Each register turns a hash into an exponential number of its own and keeps the least, exponentially spaced and truncated. So the registers of a union are the
    larger of its parts' (merge), in any order and with any overlap, and those of two sets are equal about as often as the sets are alike."""
    draw = np.random.default_rng(seed)
    turn, times = (draw.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    out = np.zeros(n, np.uint16)
    for at in range(0, len(hashes), CHUNK):
        least = ((hashes[at: at + CHUNK, None] ^ turn) * (times | np.uint64(1))).min(axis=0)
        x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
        out = merge(out, np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, MOST).astype(np.uint16))
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(alike: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarities `alike`, for sets of which the first has the share u of both sizes, where `more` registers are larger in the first, `less` in the second, `equal` in both."""
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * alike), p(v - u * alike)
    part = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0)
    return part(more, a) + part(less, b) + part(equal, 1 - a - b)


def estimates(more: np.ndarray, less: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The likeliest similarities: the likelihood has one peak, found by golden sections between 0 and the most that the sizes allow."""
    ratio = (np.sqrt(5) - 1) / 2
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        width = ratio * (hi - lo)
        a, b = hi - width, lo + width
        left = log_likelihood(a, more, less, equal, u) > log_likelihood(b, more, less, equal, u)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, key: str, text: str, row: str) -> DataFrame:
    """(doc_id, row, whole, size, registers, keys): of each text's set of shingles a digest, its size, its registers, two bytes each, and a key of each band (none for the empty set)."""
    n = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, text=0)):
            whole, size, held, keys = [], [], [], []
            for value in batch.column(0):
                own = np.unique(np.array(shingle_hashes(value.as_py(), shingle), np.uint64))
                found = registers(own, n)
                whole.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                held.append(found.tobytes())
                keys.append([xxhash.xxh64_intdigest(found[b * rows: (b + 1) * rows].tobytes(), b) for b in range(bands)] if len(own) else [])
            signed = [np.array(k, np.uint64).view(np.int64) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(whole, pa.binary()), pa.array(size, pa.int64()), pa.array(held, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], ["doc_id", row, "whole", "size", "registers", "keys"])

    own = docs.select(F.col(text).cast("string").alias("text"), *carried(key, row))
    return own.mapInArrow(run, f"doc_id long, {row} long, whole binary, size long, registers binary, keys array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, alike: float, n: int) -> DataFrame:
    """(a, b, estimate) of pairs whose registers leave a similarity of `alike` possible; nodes has (node, size, registers)."""
    both = pairs
    for x in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("registers").alias(f"registers_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, n) for c in (4, 5))
            more, less = (x > y).sum(1), (x < y).sum(1)
            equal = n - more - less
            p, q = (batch.column(c).to_numpy().astype(float) for c in (2, 3))
            u = p / (p + q)
            best = estimates(more, less, equal, u)
            loss = log_likelihood(best, more, less, equal, u) - log_likelihood(np.full(len(u), alike), more, less, equal, u)
            keep = pa.array((best >= alike) | (loss <= SLACK))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(best).filter(keep)], ["a", "b", "estimate"])

    return both.select("a", "b", "size_a", "size_b", "registers_a", "registers_b").mapInArrow(run, "a long, b long, estimate double")


def similar_sets(docs: DataFrame, shingle: int = 5, alike: float = 0.8, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, group) and `row` if given, a column of docs that tells rows apart: documents whose sets of shingles have a similarity (Jaccard) of `alike` or more are linked.

    group is null for a document that is like no other, else the same for all that a document reaches over links; component_id is the smallest doc_id there, its own
    without a group. Candidates share the registers of a band; those that the likelihood of their registers rules out go, the others' whole sets are compared. Equal
    sets are one node, so copies cost no more than one. A key that many nodes share isn't expanded into
    pairs (key_groups); what is apart in the end is paired by its rarest elements (rest_pairs).

    Null and empty texts have an empty set, which is linked with nothing, its equals neither; rows of one doc_id each keep their row; rows without a doc_id are linked like others,
    component_id is null if all of a group have none; empty tables give no rows; other columns are ignored."""
    at = row or "__row"
    docs = docs if row else with_rows(docs.select(key, text), key, "set-rows")
    found = staged(sketches(docs, shingle, bands, rows, key, text, at), "set-sketches")
    nodes = found.where("size > 0").groupBy("whole").agg(F.min(at).alias("node"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "registers", "keys")))
    nodes = staged(nodes, "set-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted, n = counted(wanted.select(F.col("node").alias(at)), "sets-wanted")
        texts = join_checked(docs.select(F.col(at).cast("long"), F.col(text).cast("string").alias("text")), wanted, at, rows=n).select(F.col(at).alias("node"), "text")
        return staged(shingle_sets(texts, shingle), "shingle-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        kept = staged(likely(pairs, nodes, alike, bands * rows), "likely-pairs")
        sets = sets_of(kept.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = kept.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * round(alike * 100)).select("a", "b")

    linked = key_groups(nodes.select("node", "size", "keys"), alike, verify, lambda left: rest_pairs(left, sets_of(left.select("node")), alike))
    joint = nodes.select("whole", "node", "n").join(linked, "node", "left").where("n > 1 or component is not null").select("whole", F.coalesce("component", "node").alias("group"))
    groups, n = counted(joint, "set-groups")
    placed = staged(join_checked(found.select("doc_id", at, "whole", "size"), groups, "whole", "left", rows=n).select("doc_id", at, "size", "group"), "set-placed")
    least, m = counted(placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "set-least")
    out = join_checked(placed, least, "group", "left", rows=m)
    own = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", *([row] if row else []), F.col("size").alias("n_shingles"), own.alias("component_id"), "group")
