"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, join_checked, staged, with_rows
from .prefix_pairs import set_pairs
from .simhash_links import fingerprint_groups, key_groups
from .words import slices

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each window of words, lower case in A-Z only, joined by one space; of all words where they are fewer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and white space is 20 and 09-0D
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), (ends[k - 1:] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """For each text, whose number of hashes `counts` gives, `words` 64-bit words of its fingerprint.

    A bit is 1 if it is set in over half of the text's hashes. The first word takes the hashes as they
    are, each further one takes them mixed anew."""
    out = np.zeros((len(counts), words), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = np.concatenate([[0], np.cumsum(counts[some])])
    # groups of at most 255 hashes of one text, so that their bits can be added as bytes, eight at a time
    groups = -(-counts[some] // 255)
    of = np.repeat(np.arange(len(some)), groups)
    at = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups))
    for w in range(words):
        h = hashes
        if w:
            h = hashes + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(bits, at, axis=0).view(np.uint8).reshape(-1, 64)
        total = np.add.reduceat(sums, np.cumsum(groups) - groups, axis=0, dtype=np.int64)
        out[some, w] = np.packbits(2 * total > counts[some][:, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, f0, f1, ...) and `row` if given: the SimHash of each whole text, 64 bits a column. A null text or one without words has zeros."""
    names = ["doc_id", *([row] if row else []), *(f"f{w}" for w in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, here = batch.column(0), 0
            while here < len(texts):
                hashes: list[int] = []
                counts: list[int] = []
                while here + len(counts) < len(texts) and len(hashes) < CHUNK:
                    own = shingle_hashes(texts[here + len(counts)].as_py(), shingle)
                    counts.append(len(own))
                    hashes += own
                prints = majority_bits(np.array(hashes, np.uint64), np.array(counts, np.int64), words).view(np.int64)
                part = batch.slice(here, len(counts))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(prints[:, w]) for w in range(words))], names)
                here += len(counts)

    own = docs.select(F.col(text).cast("string").alias("text"), *carried(key, row))
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def carried(key: str, row: str | None) -> list:
    return [F.col(key).cast("long").alias("doc_id"), *([F.col(row).cast("long")] if row else [])]


def with_groups(rows: DataFrame, nodes: DataFrame, found: DataFrame, by: list[str], row: str | None) -> DataFrame:
    """(doc_id, by, component_id, group) and `row` if given, for each of rows: its group, and the smallest doc_id there.

    nodes: (node, by, id, n), a row for each class of equal rows; found: (node, component) of linked nodes."""
    joint = nodes.join(found, "node", "left").where("n > 1 or component is not null").withColumn("group", F.coalesce("component", "node"))
    joint = staged(joint.select(*by, "id", "group"), "near-classes")
    least = joint.groupBy("group").agg(F.min("id").alias("component_id"))
    groups, n = counted(joint.join(least, "group").select(*by, "group", "component_id"), "near-groups")
    out = join_checked(rows, groups, by, "left", rows=n)
    return out.select("doc_id", *([row] if row else []), *by, F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, width: int = 32, most: int = 3, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, f0, ..., component_id, group) and `row` if given, a column of docs that tells rows apart; a row for each row of docs.

    group is null for a row that is like no other, else the same for all that a document reaches over links, and component_id the smallest doc_id there, its
    own included; fingerprints that
    differ in `most` bits or fewer are linked. With 4 * words > most every such link counts; beyond that, those that agree up to
    one bit in a segment. Equal fingerprints are one node, so groups of copies cost nothing more. Null and
    empty texts share the fingerprint zero and are linked like any other; rows of one doc_id each keep their row; rows with a null
    doc_id are linked like others (component_id is null if all rows of a group have none); an empty table gives no rows;
    other columns are ignored."""
    prints = [f"f{w}" for w in range(words)]
    rows = staged(fingerprints(docs, shingle, words, key, text, row), "simhash")
    node = F.col("f0") if words == 1 else F.xxhash64(*prints)
    nodes = staged(rows.groupBy(*prints).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).withColumn("node", node), "simhash-nodes")
    return with_groups(rows, nodes, fingerprint_groups(nodes.drop("n", "id"), words, width, most), prints, row)


def one_of_each(docs: DataFrame, find: Callable[..., DataFrame], **how) -> DataFrame:
    """docs with one row of each group that find (near_duplicates or similar_documents, with the options `how`) gives: the smallest doc_id's, null last.

    Of several rows of that id the first stored stays. All columns stay; an empty table gives no rows."""
    rows = with_rows(docs, "doc_id", "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    groups = staged(find(rows, row="__row", **how).where("group is not null").select("doc_id", "__row", "group"), "near-found")
    first = groups.groupBy("group").agg(F.min(order).alias("first"))
    spare, n = counted(groups.join(first, "group").where(F.col("__row") != F.col("first.__row")).select("__row"), "near-spare")
    return join_checked(rows, spare, "__row", "left_anti", rows=n).drop("__row")


def shingle_sketches(docs: DataFrame, shingle: int, bands: int, rows: int, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, f0, whole, size, keys) and `row` if given: the SimHash of each text's shingles, a hash of their set, its size, and `bands` keys, each of `rows` minima of the set (none without words)."""
    draw = np.random.default_rng(SEED)
    turn, times = (draw.integers(0, 1 << 64, bands * rows, dtype=np.uint64) for _ in range(2))
    names = ["doc_id", *([row] if row else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, text=0)):
            prints, some, whole, size, keys = [], [], [], [], []
            for value in batch.column(0):
                some.append(np.array(shingle_hashes(value.as_py(), shingle), np.uint64))
                if sum(map(len, some)) >= CHUNK or len(size) + 1 == batch.num_rows:
                    prints.append(majority_bits(np.concatenate(some), np.array([*map(len, some)], np.int64), 1)[:, 0])
                    own, some = np.unique(some[-1]), []
                else:
                    own = np.unique(some[-1])
                whole.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(own), 1024):
                    least = np.minimum(least, ((own[at: at + 1024, None] ^ turn) * (times | np.uint64(1))).min(axis=0))
                keys.append([xxhash.xxh64_intdigest(least[b * rows: (b + 1) * rows].tobytes(), b) for b in range(bands)] if len(own) else [])
            signed = [np.array(k, np.uint64).view(np.int64) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], [*names, "f0", "whole", "size", "keys"])

    own = docs.select(F.col(text).cast("string").alias("text"), *carried(key, row))
    return own.mapInArrow(run, f"{', '.join(f'{n} long' for n in names)}, f0 long, whole long, size long, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, held): the set of the shingles' hashes of each row of docs (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            held = [np.unique(np.array(shingle_hashes(x.as_py(), shingle), np.uint64)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], ["node", "held"])

    return docs.select("node", "text").mapInArrow(run, "node long, held array<long>")


def shared_rooms(sets: DataFrame, alike: float) -> DataFrame:
    """(node, room): for sets (node, held) how many elements another of them holds as well; without those that so have too few to be like any.

    Twice, as the sets that go leave others with elements of their own. Counts of elements meet before the shuffle."""
    room = F.col("size") - F.coalesce("lone", F.lit(0))
    for _ in range(2):
        one = sets.select("node", F.explode("held").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
        lone, n = counted(one.groupBy("node").agg(F.count("*").alias("lone")), "lone")
        rest = join_checked(sets.withColumn("size", F.size("held")), lone, "node", "left", rows=n).where(room >= F.col("size") * alike)
        sets = staged(rest.select("node", "held", room.alias("room")), "shared-sets")
    return sets.select("node", "room")


def rest_pairs(nodes: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """(a, b) of set_pairs, without the sets that hold too much of their own."""
    room, n = counted(shared_rooms(sets, alike).select("node"), "rest-rooms")
    return set_pairs(nodes, join_checked(sets, room, "node", rows=n), alike)


def similar_documents(docs: DataFrame, shingle: int = 5, alike: float = 0.8, bands: int = 20, rows: int = 6, most: int = 3, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, whole, component_id, group) and `row` if given: documents whose sets of shingles have a similarity (Jaccard) of `alike` or more are linked.

    First all whose SimHashes differ in `most` bits or fewer are candidates, by multi-index hashing as in near_duplicates. Pairs at 0.8 differ in some ten bits, so minima add candidates between the
    groups so found: a pair of similarity s is a candidate with a probability of 1 - (1 - s ** rows) ** bands, 99.8 % at 0.8; the sets
    themselves decide; rows still apart under a key are paired by their rarest elements (rest_pairs). Equal sets are one node, of which one text is looked up, by its row. Nulls, empty texts, repeated and null ids count as in near_duplicates."""
    at = row or "__row"
    docs = docs if row else with_rows(docs.select(key, text), key, "similar-rows")
    found = staged(shingle_sketches(docs, shingle, bands, rows, key, text, at), "sketches")
    nodes = found.groupBy(F.col("whole").alias("node")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min(at).alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("f0").alias("f0"))
    nodes = staged(nodes.withColumn("whole", F.col("node")), "sketch-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted, n = counted(wanted.join(nodes.select("node", "row"), "node").select("node", F.col("row").alias(at)), "sketch-wanted")
        texts = join_checked(docs.select(at, F.col(text).cast("string").alias("text")), wanted, at, rows=n)
        return staged(shingle_sets(texts, shingle), "shingle-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "sketch-pairs")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= (F.size("x") + F.size("y") - shared) * alike).select("a", "b")

    near = fingerprint_groups(nodes.where("size > 0").select("node", "f0"), most=most, verify=verify)
    found_groups = key_groups(nodes.select("node", "size", "keys"), alike, verify, lambda left: rest_pairs(left, sets_of(left.select("node")), alike), near)
    return with_groups(found.drop("keys", "size", "f0"), nodes.drop("keys", "row", "size", "f0"), found_groups, ["whole"], row)
