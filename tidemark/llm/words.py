"""Words of whole texts as arrays, for operators that work on batches in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes of all words, the different words, offset of each text's first word and of the end).

    Words are what white space separates, in lower case; a null text has none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = pc.utf8_split_whitespace(low)
    there = pc.greater(pc.binary_length(words.values), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there)])[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(texts) else np.zeros(1, np.int64)
    coded = words.values.filter(pa.array(there)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, ends


def letters_only(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, r"[^\p{L}]+", "")


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's letters and digits; 0 if it has none."""
    plain = pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", "").to_pylist()
    return np.array([xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in plain], np.uint64)


def compact(codes: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes whose place is kept, and the texts' new offsets."""
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def spread(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (length[0] numbers), then the same for each further one."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(at - ends + length, length) + np.arange(ends[-1])


def slices(batch: pa.RecordBatch, most_bytes: int = 3 << 20, text: int = 1):
    """Parts of a batch with some most_bytes of text in that column each; a longer text is a part of its own. What a part took is given back before the next."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    here = 0
    while here < batch.num_rows:
        upto = max(here + 1, int(np.searchsorted(size, (size[here - 1] if here else 0) + most_bytes, "right")))
        yield batch.slice(here, upto - here)
        here = upto
        pa.default_memory_pool().release_unused()
