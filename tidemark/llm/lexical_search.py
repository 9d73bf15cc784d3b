"""Ranked lexical search: an index of document shards with postings in rows of terms and whole-number impacts, searched a term at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, join_checked, staged
from .words import slices

#: A term: letters and digits of ASCII and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on bytes: A-Z in lower case, what ends a term a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text in a shard, if a document isn't longer.
SHARD_BYTES = 16 << 20
#: Different terms of items that go to the tasks at a time, some; items beyond that come in further blocks.
BLOCK_TERMS = 1_000_000
#: Rows of a row group of the index's files. Writers hold a whole row group and readers too, which without this is 100 shards at least before its size counts.
ROW_GROUP = {"parquet.block.row.count.limit": 1}
INDEX = "ids array<long>, terms array<string>, counts array<int>, slots binary, impacts binary"


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents with a term, all their terms)."""
    n = docs.select(F.regexp_count(F.col(text).cast("string"), F.lit(TERM)).alias("n"))
    got = n.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    return got.docs or 0, got.terms or 0


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(index, documents with a term). The index has a row a shard of documents: their ids, the terms and how many postings each has, and for all postings side by side, in the terms' order, the document's place in the shard and its impact.

    An impact is (1000000000 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * N) div L, tf the term's count in the document, n the document's terms, N and L those of
    all documents. A shard holds SHARD_BYTES of text or one document, so a common term is spread over all shards. Null texts have no term."""
    held, all_terms = totals(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SHARD_BYTES)):
            codes: dict[bytes, int] = {}
            code, tf, different, n = [], [], [], []
            for value in batch.column(1).cast(pa.large_binary()):
                own = Counter((value.as_py() or b"").translate(FOLD).split())
                code.append(np.fromiter((codes.setdefault(t, len(codes)) for t in own), np.int64, len(own)))
                tf.append(np.fromiter(own.values(), np.int64, len(own)))
                different.append(len(own))
                n.append(int(tf[-1].sum()))
            code, tf = np.concatenate(code), np.concatenate(tf)
            m = 75 + (25 * held * np.array(n, np.int64)) // max(all_terms, 1)
            slot = np.repeat(np.arange(len(n)), different)
            order = np.argsort(code, kind="stable")
            code, tf, slot = code[order], tf[order], slot[order]
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[slot])
            terms = pa.array(list(codes), pa.binary()).cast(pa.string())
            counts = np.bincount(code, minlength=len(codes)).astype(np.int32)
            lists = (batch.column(0), terms, pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (slot, impact))],
                ["ids", "terms", "counts", "slots", "impacts"])

    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return staged(own.mapInArrow(run, INDEX), "postings", **ROW_GROUP), held


def item_terms(items: DataFrame, index: DataFrame, held: int, key: str, text: str) -> tuple[DataFrame, int]:
    """((row, item_id, term, weight), its rows): each item's different terms that the index has, with their weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))) as often as the item has them."""
    numbered = staged(items.select(F.col(key).alias("item_id"), F.translate(F.col(text).cast("string"), UPPER, LOWER).alias("text"), F.monotonically_increasing_id().alias("row")), "search-items")
    own = numbered.select("row", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    own, n = counted(own.groupBy("row", "term").agg(F.first("item_id").alias("item_id"), F.count("*").alias("often")), "item-terms")
    wanted = own.select("term").distinct()
    every = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    df, k = counted(join_checked(every, wanted, "term", rows=n).groupBy("term").agg(F.sum("count").alias("df")), "item-df")
    weight = F.floor(1000 * F.log(F.lit(2.0 * held + 2) / (2 * F.col("df") + 1))).cast("long")
    return counted(join_checked(own, df, "term", rows=k).select("row", "item_id", "term", (F.col("often") * weight).alias("weight")).where("weight > 0"), "item-weights")


def best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0; of equal scores those with the smallest id, none last. Any order."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k:]].min()
        if least > 0:
            above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            ties = ties[np.lexsort((ids[ties], none[ties]))][: k - len(above)]
            return np.concatenate([above, ties])
    return np.flatnonzero(scores > 0)


def search_block(index: DataFrame, rows: list, k: int) -> DataFrame:
    """(row, doc_id, score): for each item of rows (row, term, weight) the k best documents of each task."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
    order = sorted(rows, key=lambda r: (r.row, r.term))
    items, first = np.unique(np.array([r.row for r in order], np.int64), return_index=True)
    ends = np.append(first, len(order))
    term, weight = np.array([terms[r.term] for r in order], np.int64), np.array([r.weight for r in order], np.int64)
    names = pa.array(list(terms), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s in range(batch.num_rows):
                held, counts, ids = (batch.column(c)[s].values for c in (1, 2, 0))
                slots, impacts = (np.frombuffer(batch.column(c)[s].as_buffer(), "<i4") for c in (3, 4))
                ends_of = np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
                at = pc.fill_null(pc.index_in(names, value_set=held), -1).to_numpy()
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
                total = np.zeros(len(ids), np.int64)
                for i in range(len(items)):
                    total[:] = 0
                    mine = slice(ends[i], ends[i + 1])
                    for p, w in zip(at[term[mine]].tolist(), weight[mine].tolist(), strict=True):
                        if p >= 0:
                            total[slots[ends_of[p]: ends_of[p + 1]]] += w * impacts[ends_of[p]: ends_of[p + 1]].astype(np.int64)
                    got = best(total, ids, none, k)
                    if len(got):
                        found = (total[got], ids[got], none[got])
                        if i in top:
                            found = tuple(map(np.concatenate, zip(top[i], found, strict=True)))
                            got = best(*found, k)
                            found = tuple(x[got] for x in found)
                        top[i] = found
        if top:
            score, ids, none = (np.concatenate(x) for x in zip(*top.values(), strict=True))
            row = np.repeat(items[list(top)], [len(x[0]) for x in top.values()])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids, mask=none), pa.array(score)], ["row", "doc_id", "score"])

    return index.mapInArrow(run, "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k best documents with a score above 0; equal scores by doc_id, null last.

    All documents are indexed; the items' terms go to the tasks in blocks of some BLOCK_TERMS, each task adds an item's impacts a term at a time into one number a document of
    a shard, and hands on k documents an item, whatever its shards; these meet in Spark.

    Null and empty texts and items have no term and no row; each of several items of one id, and each of several documents of one id, counts for itself;
    empty tables give no rows; other columns are ignored."""
    index, held = build_index(docs, key, text)
    wanted, n = item_terms(items, index, held, item, item_text)
    blocks, found = -(-n // BLOCK_TERMS), None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "term", "weight").collect()
        if rows:
            part = search_block(index, rows, k)
            found = part if found is None else found.unionByName(part)
    kind = items.schema[item].dataType.simpleString()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # k rows an item and task
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids, m = counted(wanted.select("row", "item_id").distinct(), "searched-items")
    return join_checked(ranked, ids, "row", rows=m).select("item_id", "rank", "doc_id", "score")
