"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import coded_words, compact, slices, spread, word_hashes

#: Words of a seed.
GRAM = 3
MATCH, MISS, GAP = 2, -1, -1
#: Share of the best possible score of an item's own words from which a passage counts as its copy.
LEAST = 0.5
#: Words of benchmark items that are sent to every executor at a time; larger benchmarks go in blocks.
BLOCK_WORDS = 1_000_000


@dataclass
class Items:
    """Items of a block: word hashes side by side, and their n-grams in order of hash."""

    ids: list[int]
    words: np.ndarray
    ends: np.ndarray
    gram: np.ndarray  # different n-gram hashes, ascending
    first: np.ndarray  # by n-gram, its first place in item and at
    item: np.ndarray
    at: np.ndarray
    sizes: tuple[int, ...]
    maybe: np.ndarray  # by the low bits of a hash: whether an n-gram has them


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row of a flat array, whatever text they belong to."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k: k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def items_of(ids: list[int], texts: list[str | None], kept: set[int] | None = None) -> Items:
    """The items that have a word. Items with fewer words than GRAM have one n-gram, all of them. kept: the hashes of the n-grams to use."""
    codes, words, ends = coded_words(pa.array(texts, pa.string()))
    hashes = word_hashes(words)[codes]
    hashes, ends = compact(hashes, ends, hashes != 0)
    rows = []
    for i in range(len(ids)):
        own = hashes[ends[i]: ends[i + 1]]
        if len(own):
            rows += [(int(h), i, k) for k, h in enumerate(gram_hashes(own, min(GRAM, len(own))).tolist()) if kept is None or h in kept]
    rows.sort()
    flat = np.array([r[0] for r in rows], np.uint64)
    gram, first = np.unique(flat, return_index=True)
    size = 1 << max(12, int(np.ceil(np.log2(len(gram) + 1))) + 4)
    maybe = np.zeros(size, bool)
    maybe[(gram & np.uint64(size - 1)).astype(np.int64)] = True
    sizes = tuple(sorted({min(GRAM, n) for n in np.diff(ends).tolist() if n}))
    return Items(ids, hashes, ends, gram, np.append(first, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), sizes, maybe)


def hits(items: Items, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, n-gram) of each n-gram of the texts that is an item's."""
    places, grams = [], []
    for size in items.sizes:
        h = gram_hashes(hashes, size)
        some = np.flatnonzero(items.maybe[(h & np.uint64(len(items.maybe) - 1)).astype(np.int64)])
        if not len(some) or not len(items.gram):
            continue
        g = np.minimum(np.searchsorted(items.gram, h[some]), len(items.gram) - 1)
        ok = items.gram[g] == h[some]
        some, g = some[ok], g[ok]
        ok = np.searchsorted(ends, some, "right") == np.searchsorted(ends, some + size - 1, "right")  # within one text
        places.append(some[ok])
        grams.append(g[ok])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, grams = np.concatenate(places), np.concatenate(grams)
    order = np.argsort(places, kind="stable")
    return places[order], grams[order]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best score, word after its end) of Smith-Waterman alignments of an item with each window, a row of word hashes (0: none)."""
    n, width = windows.shape
    steps = np.arange(width + 1) * -GAP
    row, best, end = np.zeros((n, width + 1), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(windows == word, MATCH, MISS), row[:, 1:] + GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps, axis=1) - steps, 0)
        at = new.argmax(1)
        top = new[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        row = new
    return best, end


def passages(items: Items, hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of each aligned passage: for each text and item the best one.

    Seeds of a text and item whose diagonals are near each other share a window, as long as the item and
    a margin at either end; the window is aligned with the item from both ends, which gives the passage's bounds."""
    place, gram = hits(items, hashes, ends)
    if not len(place):
        return []
    count = items.first[gram + 1] - items.first[gram]
    entry = spread(items.first[gram], count)
    place, item, at = np.repeat(place, count), items.item[entry], items.at[entry]
    text = np.searchsorted(ends, place, "right") - 1
    length = np.diff(items.ends)
    margin = 4 + length[item] // 4
    diagonal = place - at
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal, margin = text[order], item[order], diagonal[order], margin[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > margin[1:])])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(new)) - 1
    lo = np.maximum(ends[text[start]], diagonal[start] - margin[start])
    hi = np.minimum(ends[text[start] + 1], diagonal[last] + length[item[start]] + margin[start])
    text, item = text[start], item[start]
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i in np.unique(item).tolist():
        word = items.words[items.ends[i]: items.ends[i + 1]]
        mine = np.flatnonzero(item == i)
        mine = mine[np.argsort(hi[mine] - lo[mine], kind="stable")]
        for k in range(0, len(mine), 256):
            some = mine[k: k + 256]
            windows = np.zeros((len(some), int((hi - lo)[some].max())), np.uint64)
            for r, c in enumerate(some.tolist()):
                windows[r, : hi[c] - lo[c]] = hashes[lo[c]: hi[c]]
            best, end = align(word, windows)
            score = best / (MATCH * len(word))
            good = np.flatnonzero(score >= LEAST)
            if not len(good):
                continue
            back = np.zeros((len(good), int(end[good].max())), np.uint64)
            for r, g in enumerate(good.tolist()):
                back[r, : end[g]] = windows[g, : end[g]][::-1]
            taken = align(word[::-1], back)[1]
            for g, size in zip(good.tolist(), taken.tolist(), strict=True):
                c = some[g]
                base = int(lo[c] - ends[text[c]])
                found = (float(score[g]), -(base + int(end[g]) - size), -(base + int(end[g])))
                spot = (int(text[c]), i)
                out[spot] = max(out.get(spot, (-1.0, 0, 0)), found)
    return [(t, i, s, -a, -b) for (t, i), (s, a, b) in sorted(out.items())]


def held_grams(items: Items, used: dict[int, int]) -> set[int]:
    """Seeds: the n-grams of the items that any document has.

    So a copy that leaves GRAM words in a row unchanged holds a seed of its item, however common the item is."""
    return {h for h in items.gram.tolist() if used.get(h, 0)}



def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each document and item of which it holds a copy, edited ones too.

    score is the best local alignment's, over that of the whole item; pairs from LEAST on count. Words are compared by their letters and digits
    in lower case. Two passes over all documents: the first counts, for each n-gram of the items, the
    documents that have it; the second looks those up that any has and aligns around them. Items go to the tasks, in blocks of
    BLOCK_WORDS words, and documents stay where they are, so neither a passage that many documents hold
    nor a long document gathers anywhere.

    Null and empty texts and items match nothing; repeated rows of a document, and items that are equal, each give their pairs; an item of one or two words needs
    them in a row; empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    size = bench.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-size // BLOCK_WORDS)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        items = items_of([r.id for r in rows], [r.text for r in rows])
        found = found.unionByName(_block(texts, items, rows))
    return found


def _block(texts: DataFrame, items: Items, rows: list) -> DataFrame:
    def doc_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        codes, words, ends = coded_words(part.column(1))
        hashes = word_hashes(words)[codes]
        return compact(hashes, ends, hashes != 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(len(items.gram), np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes, ends = doc_words(part)
                place, gram = hits(items, hashes, ends)
                if len(place):
                    pairs = np.unique((np.searchsorted(ends, place, "right") - 1) * len(items.gram) + gram)
                    used += np.bincount(pairs % len(items.gram), minlength=len(items.gram))
        some = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], ["gram", "n"])

    used = staged(texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts").collect()  # a row an n-gram of the block at most
    seeds = items_of([r.id for r in rows], [r.text for r in rows], held_grams(items, {int(items.gram[r.gram]): r.n for r in used}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if got := passages(seeds, *doc_words(part)):
                    docs = part.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([docs[t] for t, *_ in got], pa.int64()), pa.array([seeds.ids[i] for _, i, *_ in got], pa.int64()), pa.array([s for _, _, s, _, _ in got]), pa.array([a for *_, a, _ in got], pa.int64()), pa.array([e for *_, e in got], pa.int64())],
                        ["doc_id", "item_id", "score", "first_word", "end_word"])

    return texts.mapInArrow(search, "doc_id long, item_id long, score double, first_word long, end_word long")
