"""Language identification as inference of a mixture: each document's language proportions by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import coded_words, compact, letters_only, slices, spread

#: Cells that byte trigrams hash to, and what is added to each count.
CELLS, SMOOTH = 1 << 16, 0.1
#: Steps of expectation-maximisation, words whose steps are taken together, and a language's price in log likelihood per log of the words.
STEPS, TOGETHER, PRICE = 6, 100_000, 2.0
#: What one word can say for a language against another: names and loan words must not decide alone.
CLIP = 12.0


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all words' byte trigrams with a space at either end, number of them by word)."""
    words = words.cast(pa.large_binary())
    length = pc.binary_length(words).to_numpy().astype(np.int64)
    at, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words)], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    n = np.where(length > 0, length, 0)
    padded = np.full(int((n + 2).sum()), 32, np.uint32)
    begins = np.cumsum(n + 2) - (n + 2)
    padded[spread(begins + 1, n)] = data[spread(at, n)]
    mixed = (padded[:-2] * np.uint32(65536) + padded[1:-1] * np.uint32(256) + padded[2:]) * np.uint32(2654435761) >> np.uint32(16) if len(padded) > 2 else padded[:0]
    return mixed[spread(begins, n)].astype(np.int64), n


def lettered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """coded_words() of the words' letters, without words that have none."""
    codes, words, ends = coded_words(texts)
    words = letters_only(words)
    has = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    codes, ends = compact(codes, ends, has[codes])
    return codes, words, ends


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each cell by language) from every row of docs with a language.

    Each task counts its rows' trigrams, so what moves is at most CELLS numbers a language and task; what the driver
    gets is CELLS numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                codes, words, ends = lettered(part.column(1))
                cells, n = trigrams(words)
                first = np.cumsum(n) - n
                langs = np.array(part.column(0).to_pylist(), object)
                of_word = np.repeat(np.arange(len(langs)), np.diff(ends))
                for name in set(langs):
                    used = np.bincount(codes[(langs == name)[of_word]], minlength=len(words)) if len(codes) else np.zeros(len(words))
                    some = np.flatnonzero(used)
                    own = np.bincount(cells[spread(first[some], n[some])], np.repeat(used[some], n[some]), CELLS)
                    totals[name] = totals.get(name, 0) + own
        for name, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(own[some].astype(np.int64))], ["lang", "cell", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    table = np.full((CELLS, len(names)), SMOOTH)
    for i, name in enumerate(names):
        own = rows[rows["lang"] == name]
        table[own["cell"].to_numpy(), i] += own["n"].to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32) if names else table.astype(np.float32)


def proportions(likelihood: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language proportions, log likelihood) of each text, from its words' likelihoods, by expectation-maximisation from `start`."""
    n = np.diff(np.append(first, len(likelihood)))
    p, total = start, None
    for _ in range(STEPS):
        part = likelihood * np.repeat(p, n, axis=0)
        whole = part.sum(1, keepdims=True)
        p = np.add.reduceat(part / whole, first, axis=0) / n[:, None]
    total = np.add.reduceat(np.log((likelihood * np.repeat(p, n, axis=0)).sum(1)), first)
    return p, total


def languages(likelihood: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The proportions of each text's languages; those that are not worth their price are 0.

    Starts with all languages. A text first tries to do without all its rare ones together, then without
    the rarest left, as long as the penalised likelihood does not fall."""
    n = np.diff(ends)
    p, total = proportions(likelihood, ends[:-1], np.full((len(n), likelihood.shape[1]), 1 / likelihood.shape[1], np.float32))
    open_, rare = np.arange(len(n)), True
    while len(open_) and likelihood.shape[1] > 1:
        now = p[open_]
        alive = now > 0
        lowest = np.where(alive, now, 2).argmin(1)
        fewer = now.copy()
        if rare:
            fewer[now < 0.02] = 0
        else:
            fewer[np.arange(len(fewer)), lowest] = 0
        less = alive.sum(1) - (fewer > 0).sum(1)
        can = (fewer > 0).any(1) & (less > 0)
        tried, fewer, less = open_[can], fewer[can], less[can]
        if len(tried):
            q, got = proportions(likelihood[spread(ends[tried], n[tried])], np.cumsum(n[tried]) - n[tried], fewer / fewer.sum(1, keepdims=True))
            better = got + PRICE * less * np.log(n[tried] + 1) >= total[tried]
            p[tried[better]], total[tried[better]] = q[better], got[better]
        open_ = open_ if rare else tried[better] if len(tried) else tried
        rare = False
    return p


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs), a row for each row of docs.

    A word's likelihood under a language is that of its byte trigrams, its spread between languages cut at CLIP. A text is a mixture of
    languages word by word; lang_pred has the largest proportion (ties: first by name), score is the proportion, and
    langs lists the selected languages from the largest. A null text and one without a letter get `und`, 0 and
    no language, and so does every text if nothing was learned. Rows that repeat each keep their row; an empty table gives no rows;
    columns other than key and text are not read. Rows do not move; a task holds some megabytes of text at a time, or
    one text if that is longer."""
    names, table = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.array(names, object)
        for batch in batches:
            for part in slices(batch):
                codes, words, ends = lettered(part.column(1))
                pred, score, langs = np.full(part.num_rows, "und", object), np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                some = np.flatnonzero(np.diff(ends)) if names else np.zeros(0, np.int64)
                if len(some):
                    cells, n = trigrams(words)
                    logs = np.zeros((len(words), len(names)), np.float32)
                    used = np.flatnonzero(n)
                    logs[used] = np.add.reduceat(table[cells], (np.cumsum(n) - n)[used], axis=0)
                    word_likelihood = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -CLIP))
                    here = 0
                    while here < len(some):  # texts of about TOGETHER words at a time
                        upto = here + 1
                        while upto < len(some) and ends[some[upto] + 1] - ends[some[here]] <= TOGETHER:
                            upto += 1
                        own = some[here:upto]
                        length = ends[own + 1] - ends[own]
                        p = languages(word_likelihood[codes[spread(ends[own], length)]], np.concatenate([[0], np.cumsum(length)]))
                        best = p.argmax(1)
                        pred[own], score[own] = order[best], np.clip(p[np.arange(len(own)), best], 0, 1)
                        for i, row in zip(own, p, strict=True):
                            langs[i] = [names[j] for j in np.argsort(-row, kind="stable") if row[j] > 0]
                        here = upto
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(langs, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "langs"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>")
