"""Token counts of fields and sections: documents are encoded once, and their tokens' spans joined to the sections' spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")

_encodings: dict[str, tuple] = {}


def encoding(path: str, pattern: str):
    """(encoding, bytes of each token), kept for a worker's later batches."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _encodings[path]


def allocate(ends: np.ndarray, first: np.ndarray, raw: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens allocated) of each section.

    ends: byte at which each token ends; first: byte at which each section begins, from 0 on; raw: the text's bytes. A token
    within one section counts there. One that crosses goes to the section of its first character, of its last, or to
    the one with most of its characters (ties: the earlier); a character counts where its first byte is, and a token
    without a character's first byte belongs to the section of the character that it continues. Empty sections get none."""
    starts = np.concatenate([[0], ends[:-1]])
    a, b = (np.searchsorted(first, x, "right") - 1 for x in (starts, ends - 1))
    into = a.copy()
    crossing = np.flatnonzero(a != b)
    if rule == "last":
        into[crossing] = b[crossing]
    elif rule == "most" and len(crossing):
        heads = (raw & 0xC0) != 0x80
        for t in crossing.tolist():
            cut = np.concatenate([[starts[t]], first[a[t] + 1: b[t] + 1], [ends[t]]])
            own = [int(heads[i:j].sum()) for i, j in zip(cut, cut[1:], strict=False)]
            into[t] = a[t] + int(np.argmax(own))
    n = len(first)
    return np.bincount(into, minlength=n), np.bincount(into[crossing], minlength=n)


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "most", fields: tuple[str, ...] = ("text",), lines: bool = True, joint: str = "\n", key: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, first_char, n_chars, n_tokens, n_crossing), a row for each section of each row of docs.

    A document is its fields in order with `joint` between them, encoded whole, once. A field and the joint after it
    are a section, or, with lines, each of its lines with the line's end is. Tokens join the sections that their spans
    overlap; allocate() has the rule for those that cross. So the sections' tokens add up to the document's.

    A null field is empty; an empty field or line without an end is a section without tokens; special-token strings are ordinary
    text; repeated rows each give their rows; an empty table gives none; other columns are ignored. The join happens within
    the document, where both sides are in order: no row moves, and a hot source or group of copies costs its length only."""
    assert rule in RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length = encoding(path, pattern)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for here in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for row in zip(*(c[here: here + 200] for c in columns), strict=True):
                    parts = [x or "" for x in row[1:]]
                    text = joint.join(parts)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    bounds, names, at = [], [], 0
                    for name, part in zip(fields, parts, strict=True):
                        body = np.frombuffer(part.encode(), np.uint8)
                        begins = np.concatenate([[0], np.flatnonzero(body == 10) + 1]) if lines else np.zeros(1, np.int64)
                        bounds.append(at + begins)
                        names += [name] * len(begins)
                        at += len(body) + len(joint.encode())
                    first = np.concatenate(bounds)
                    ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                    tokens, crossing = allocate(np.cumsum(length[ids]), first, raw, rule) if len(ids) else (np.zeros(len(first), np.int64),) * 2
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[np.minimum(np.append(first, len(raw)), len(raw))]
                    out.append((np.full(len(first), row[0] or 0), np.full(len(first), row[0] is None), names, np.arange(len(first)), chars[:-1], np.diff(chars), tokens, crossing))
                cols = [np.concatenate([o[k] for o in out]) for k in (0, 1, 3, 4, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64(), mask=cols[1].astype(bool)), pa.array([x for o in out for x in o[2]], pa.string()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                    ["doc_id", "field", "section", "first_char", "n_chars", "n_tokens", "n_crossing"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), *(F.col(f).cast("string") for f in fields)).mapInArrow(run, "doc_id long, field string, section int, first_char long, n_chars long, n_tokens long, n_crossing long")
