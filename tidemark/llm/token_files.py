"""Token ids in binary files: Simple-8b word-aligned coding.

A file is a run of records, each ended by one byte 0x0A. All numbers are little-endian.

block record: b"S8B1", u32 documents, u32 ids, u32 words, then
    u8[documents]       1 if the document's key is null
    i64[documents]      the keys
    u32[documents + 1]  offset of each document's first id among the block's ids
    u64[words]          coded words
index record, the last of a file: b"S8BX", u32 blocks, u64[blocks] byte offset of each block record.

A coded word has its selector in the top four bits. Selectors 0 to 13 pack a fixed number of
ids of a fixed width, the first id in the lowest bits; the ids of the last word of a block may stop early.
Selector 14 is not used. Selector 15 is an escape: the next word holds one id of more than 60 bits as it is. So each word's number of ids follows from
its selector, and a block is decoded by a cumulative sum and one gather for each selector."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, new_path, staged

#: (ids in a word, bits of each) by selector: the fixed table of the coding.
PACKING = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE, RAW = 15, 16
BLOCK_IDS = 1 << 16
TAIL = ".,;:!?*$#%&|<>()\"-"
CACHED_WORDS = 500_000


def fits(ids: np.ndarray) -> np.ndarray:
    """For each id the first selector wide enough for it."""
    widths = np.array([1 << b for _, b in PACKING], np.uint64)
    if len(ids) and int(ids.max()) < len(_FITS):
        return _FITS[ids.astype(np.int64)]
    return np.searchsorted(widths, ids, side="right").astype(np.uint8)


_FITS = np.searchsorted(np.array([1 << b for _, b in PACKING]), np.arange(1 << 16), side="right").astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """ids (unsigned 64-bit) as coded words: each takes the most ids that fit, from the left."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # top[c][i]: the widest need of the c ids from i on, grown from smaller windows; past the end nothing is needed
    need = np.zeros(n + 64, np.uint8)
    need[:n] = fits(ids)
    top = {1: need}
    for c in sorted(c for c, _ in PACKING)[1:]:
        half = max(x for x in top if 2 * x >= c or x == max(top))
        half = min((x for x in top if 2 * x >= c), default=half)
        top[c] = np.maximum(top[half][: n + 64 - c], top[half][c - half: n + 64 - half])
    best = np.full(n, ESCAPE, np.uint8)
    for s in range(len(PACKING) - 1, -1, -1):
        best[top[PACKING[s][0]][:n] <= s] = s
    jump = np.array([c for c, _ in PACKING] + [0, 1], np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts)
    kinds = best[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    padded = np.zeros(n + 64, np.uint64)
    padded[:n] = ids
    for s, (count, bits) in enumerate(PACKING):
        if len(w := np.flatnonzero(kinds == s)):
            at, packed = starts[w], words[w]
            for k in range(count):
                packed |= padded[at + k] << np.uint64(bits * k)
            words[w] = packed
    if len(w := np.flatnonzero(kinds == ESCAPE)):
        words = np.insert(words, w + 1, padded[starts[w]])
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that pack() coded."""
    words = np.ascontiguousarray(words, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kinds == ESCAPE).tolist():  # the word after an escape is an id, whatever its top bits
        if not raw[i]:
            raw[i + 1] = True
    kinds[raw] = RAW
    counts = np.array([c for c, _ in PACKING] + [0, 0, 1])[kinds]
    offsets = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKING):
        if len(w := np.flatnonzero(kinds == s)):
            at, packed = offsets[w], words[w]
            for k in range(count):
                out[at + k] = (packed >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)
    out[offsets[raw]] = words[raw]
    return out[:n]


def block(keys: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words = pack(ids)
    head = struct.pack("<4sIII", b"S8B1", len(keys), len(ids), len(words))
    nulls = np.array([k is None for k in keys], np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype("<u4")
    return head + nulls.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + at.tobytes() + words.astype("<u8").tobytes()


def blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, id offsets, ids) of each block of a file, found by the file's index record."""
    p = 0
    while p < len(content):
        kind, docs, ids, words = struct.unpack_from("<4sIII", content, p)
        if kind != b"S8B1":
            assert kind == b"S8BX", f"no token file: {kind!r}"
            return
        p += 16
        nulls = np.frombuffer(content, np.uint8, docs, p)
        keys = np.frombuffer(content, "<i8", docs, p := p + docs)
        at = np.frombuffer(content, "<u4", docs + 1, p := p + 8 * docs)
        coded = np.frombuffer(content, "<u8", words, p := p + 4 * (docs + 1))
        p += 8 * words + 1
        yield [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)], at, unpack(coded, ids)


class WordEncoder:
    """Whole texts by a tokenizer that drops white space, encoding each different word once.

    Holds for tokenizers whose normaliser and splitter treat white-space-separated pieces on their own, as the
    word BPE does (NFC, lower case, a split at white space): the ids of a text are those of
    its pieces in order. A text for which that can fail (special-token strings, not NFC, a capital sigma, other white
    space) is encoded whole. Words are kept for a worker's later batches, some CACHED_WORDS at most."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.seen = Tokenizer.from_file(path), {}
        # for runs of letters in NFC and lower case the normaliser and the splitter have nothing left to do
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def pieces(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes, of each of some different words."""
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        fresh = [w for w in words if w not in seen]
        letters = [w for w in fresh if w.isalpha()]
        for k in range(0, len(letters), 2000):
            some = letters[k: k + 2000]
            ids = np.array(self.letters.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cut) == len(some) + 1:
                raw = ids.tobytes()
                seen.update(zip(some, [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))
        others = [w for w in fresh if w not in seen]
        for w, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
            seen[w] = np.array(e.ids, "<u4").tobytes()
        return [*map(seen.__getitem__, words)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's first id and of the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, r"[\x1c-\x1f\x{85}Σİ]|<\|")).to_numpy(zero_copy_only=False).copy()
        low = pc.utf8_lower(texts)
        for i in np.flatnonzero(pc.match_substring_regex(texts, r"[^\x00-\x{2ff}]").to_numpy(zero_copy_only=False) & plain):
            plain[i] = unicodedata.is_normalized("NFC", texts[i].as_py()) and unicodedata.is_normalized("NFC", low[i].as_py())
        low = pc.if_else(pa.array(plain), low, "")
        words = pc.utf8_split_whitespace(low)
        flat = words.flatten()
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        per_text = np.add.reduceat(np.append(pc.greater(pc.binary_length(words.values), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64), words.offsets.to_numpy()[:-1]) if len(texts) else np.zeros(0, np.int64)
        coded = flat.dictionary_encode()
        # a different word is a core and a tail of signs, where the core ends in a letter
        different = coded.dictionary
        core = pc.utf8_rtrim(different, characters=TAIL)
        whole = pc.invert(pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1)))
        core = pc.if_else(whole, different, core)
        parts = pa.concat_arrays([core, _after(different, core)]).dictionary_encode()
        ids = self.pieces(parts.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        buf, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length
        index = parts.indices.to_numpy()
        n = len(different)
        # each different word's ids side by side, then each word of the texts
        pair = np.stack([index[:n], index[n:]], 1).ravel()
        buf, length = _gather(buf, at, length, pair), length[index[:n]] + length[index[n:]]
        at = np.cumsum(length) - length
        codes = coded.indices.to_numpy()
        out = _gather(buf, at, length, codes)
        ends = np.concatenate([[0], np.cumsum(length[codes])])[np.concatenate([[0], np.cumsum(per_text)])]
        if plain.all():
            return out, ends
        parts = [out[i:j] if ok else self.whole(texts[k].as_py()) for k, (i, j, ok) in enumerate(zip(ends, ends[1:], plain, strict=False))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _after(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What follows each word's core, of which the word starts."""
    buffers = lambda x: (np.frombuffer(x.buffers()[1], np.int64)[x.offset: x.offset + len(x) + 1], np.frombuffer(x.buffers()[2] or b"", np.uint8))
    at, data = buffers(words)
    start = at[:-1] + pc.binary_length(cores).to_numpy()
    length = at[1:] - start
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)), pa.py_buffer(_gather(data, start, length, np.arange(len(words)))))


def _gather(buf: np.ndarray, at: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of buf that start at `at` and are `length` long, for each of `which`, side by side."""
    length = length[which]
    ends = np.cumsum(length)
    if not len(which) or not ends[-1]:
        return buf[:0]
    return buf[np.repeat(at[which] - ends + length, length) + np.arange(ends[-1])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes token files under path, in ascending order of key.

    Rows are dealt by ranges of the key before they are encoded, so a file holds one range and files follow
    each other by name. Spark's own writer places the records, so a lost or repeated task leaves no half
    file and any file system will do. A null text counts as empty (its only id is end_id); a null key comes first;
    rows of one key keep together, in order of text; an empty table gives no documents; other columns are ignored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        keys, lengths, parts, n, offsets, at = [], [], [], 0, [], 0

        def close() -> bytes:
            nonlocal n
            out = block(keys, lengths, np.concatenate(parts))
            for x in (keys, lengths, parts):
                x.clear()
            n = 0
            return out

        for batch in batches:
            ids, at_id = enc.encode(batch.column(1))
            for k, i, j in zip(batch.column(0).to_pylist(), at_id[:-1].tolist(), at_id[1:].tolist(), strict=True):
                keys.append(k)
                parts += (ids[i:j], end)
                lengths.append(j - i + 1)
                n += lengths[-1]
                if n >= BLOCK_IDS:
                    offsets.append(at)
                    at += len(out := close()) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])
        if keys:
            offsets.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.binary())], ["value"])
        if offsets:
            index = struct.pack("<4sI", b"S8BX", len(offsets)) + np.array(offsets, "<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.binary())], ["value"])

    (
        docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange("key").sortWithinPartitions("key", "text")
        .mapInArrow(write, "value binary").select(F.col("value").cast("string"))
        .write.text(path)
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: (key, file int, position in its file, start within its file, n_tokens, ids_crc32, ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, k, start = int(re.search(r"part-(\d+)", name)[1]), 0, 0
                for keys, at, ids in blocks(content.as_buffer().to_pybytes()):
                    ids, rows = ids.astype("<u4"), []
                    for j, key in enumerate(keys):
                        own = ids[at[j]: at[j + 1]]
                        rows.append((key, file, k + j, start + int(at[j]), len(own), zlib.crc32(own.tobytes()), own.astype("<i8") if with_ids else None))
                    k, start = k + len(keys), start + len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["key", "file", "position", "local_start", "n_tokens", "ids_crc32", "ids"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(read, "key long, file int, position long, local_start long, n_tokens long, ids_crc32 long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: (key, start, n_tokens, ids_crc32), start counting the ids of all documents before it.

    The files' totals are one row a file; only they pass through a window without a partition."""
    rows = staged(read_token_files(spark, path, False).drop("ids"), "token-rows")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    return join_checked(rows, files.select("file", F.coalesce("before", F.lit(0)).alias("before")), "file").select("key", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' token files and returns what reading them back gives, with each document's place."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return token_index(spark, path).withColumnRenamed("key", "doc_id")
