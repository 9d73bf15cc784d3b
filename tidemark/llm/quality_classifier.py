"""Quality by compression: how much better a dictionary of good text shortens a text than one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out

#: Labelled rows of each label, at most, that dictionaries and the calibration are fitted on: half for each.
SAMPLE_ROWS = 3000
#: Labelled texts longer than this are not sampled for fitting; every text is scored whole.
SAMPLE_CHARS = 60_000
#: Sizes of the dictionaries, a pair each; bytes of a text that are compressed at a time; zstandard's level.
DICTIONARIES, PIECE, LEVEL = (2 << 10, 4 << 10, 8 << 10, 16 << 10, 32 << 10), 2 << 10, 3
#: Bytes of text for which the compressed sizes count as much as the labels' shares do.
SHORT = 100


@dataclass
class Model:
    good: list[bytes]  # a dictionary of each size
    bad: list[bytes]
    weights: np.ndarray  # of the pairs' differences and of 1
    prior: float  # log odds of the label 1


def pieces(text: str) -> list[bytes]:
    """The whole text in pieces short enough for a dictionary to matter in each."""
    raw = text.encode()
    return [raw[i: i + PIECE] for i in range(0, len(raw), PIECE)]


class Sizes:
    """Compressed sizes of a text under the dictionaries."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.pairs = [(self.compressor(g), self.compressor(b)) for g, b in zip(good, bad, strict=True)]

    @staticmethod
    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    def differences(self, text: str | None) -> list[float]:
        """For each pair of dictionaries (bytes by the bad one - bytes by the good one) / their sum, and the text's bytes; zeros for an empty text."""
        parts = pieces(text or "")
        out = []
        for pair in self.pairs:
            good, bad = (sum(len(c.compress(x)) for x in parts) for c in pair)
            out.append((bad - good) / max(1, bad + good))
        return [*out, float(sum(map(len, parts)))]


def squash(differences: np.ndarray) -> np.ndarray:
    """Differences (the last column: bytes) with the large ones, of copies of sampled texts, drawn in, and a column of 1."""
    return np.c_[np.tanh(differences[:, :-1] / 0.1), np.ones(len(differences))]


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.1) -> np.ndarray:
    """Weights of P(y = 1) over the columns of z by Newton's method, with a ridge, on targets drawn in from 0 and 1 as Platt does."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - t) + ridge * w)
    return w


def probability(model: Model, differences: np.ndarray) -> np.ndarray:
    """P(label 1): the calibrated log odds, drawn towards those of the labels alone in texts of few bytes."""
    trust = differences[:, -1] / (differences[:, -1] + SHORT)
    odds = trust * (squash(differences) @ model.weights) + (1 - trust) * model.prior
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Dictionaries and calibration from labelled rows that are not held out; None if a label has too few rows.

    A bounded sample: of each label the sample_rows rows that come first by a hash of the id, texts over SAMPLE_CHARS left out. Odd ones train
    the dictionaries, even ones the calibration, so that it sees texts the dictionaries have not. Rows without text or label,
    and labels other than 0 and 1, teach nothing."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"), F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 40)).alias("turn"))
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("label = 1").orderBy("turn", "id").limit(sample_rows).unionByName(known.where("label = 0").orderBy("turn", "id").limit(sample_rows))
    rows = (
        docs.where(F.length(text).between(1, SAMPLE_CHARS)).join(F.broadcast(chosen), F.col(key) == F.col("id"))  # 2 * sample_rows rows at most
        .select("label", "turn", "id", F.col(text).alias("text")).orderBy("turn", "id", "text").limit(2 * sample_rows).toPandas())
    first, second = rows[rows.turn % 2 == 1], rows[rows.turn % 2 == 0]
    if min((part.label == v).sum() for part in (first, second) for v in (0, 1)) < 4:
        return None
    raw: dict[int, list[bytes]] = {}
    for v in (1, 0):
        samples = [x for t in first.text[first.label == v] for x in pieces(t)]
        raw[v] = [dictionary(samples, size) for size in DICTIONARIES]
    sizes = Sizes(raw[1], raw[0])
    z, y = squash(np.array([sizes.differences(t) for t in second.text])), second.label.to_numpy()
    weights, prior = logistic(z, y), float(np.log(share[1] / share[0]))
    # the sample may have evened the labels out: back to their shares
    weights[-1] += prior - float(np.log((y == 1).sum() / (y == 0).sum()))
    return Model(raw[1], raw[0], weights, prior)


def dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, difference), a row for each row of docs; only key and text are read.

    Each whole text is compressed in pieces with the dictionaries of either side; the normalised differences of the sizes become a
    probability by the calibration. A null or empty text gets the labels' share; without a model every score is 0.5. Equal
    texts score equally, repeated rows keep a row each, and an empty table gives no rows. No row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model else None
        for batch in batches:
            if sizes and batch.num_rows:
                differences = np.array([sizes.differences(t.as_py()) for t in batch.column(1)])
                p, mean = probability(model, differences), differences[:, :-1].mean(1)
            else:
                p, mean = np.full(batch.num_rows, 0.5), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(mean)], ["doc_id", "score", "predicted", "difference"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, difference double")
