"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of letters and digits (any byte of a non-ASCII character counts as a letter) and runs of other printable
characters, case kept. Unigrams and bigrams are hashed to 2**BITS weights; a bigram of one token twice, and one whose
first word comes again after its second, share a slot each, so that repetition of any word is seen. A text's features are
its n-gram frequencies, so its score is a sparse dot product: the mean weight over its n-grams, times SCALE, plus the bias.

Training reads a bounded sample, about `sample` labelled documents chosen by a hash of the id. Their features are made
where the texts are; one task gets those, 2**(BITS + 1) a document at most, in the order of that hash. Only the weights,
2**BITS numbers at most, leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold, has_columns, in_arrow

BITS = 18
SCALE = 20.0
SAMPLE = 8_000
EPOCHS = 3
FOLDS, HELD_OUT = 3, 1
_BASE, _MIX, _PAIR = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TWICE, _AGAIN = np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)
_SPACE, _WORD, _MARK = 0, 1, 2


@cache
def _classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[[*range(33), 127]] = _SPACE
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[lo:hi] = _WORD
    return out


@cache
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(4096, _BASE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def ngrams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unigrams, bigrams, first, last): slots of all tokens and of all pairs of neighbours; text i has tokens first[i]:last[i]."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
    kind = _classes()[data]
    start = kind != _SPACE
    start[1:] &= kind[1:] != kind[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    offset = np.arange(len(data)) - at[np.maximum(np.cumsum(start) - 1, 0)]
    part = (data + np.uint64(1)) * _powers()[offset & 4095]
    part[kind == _SPACE] = 0
    token = _mix(np.add.reduceat(part, at))
    bounds = np.concatenate([[0], np.searchsorted(at, ends)])
    pair = _mix(token[:-1] * _PAIR + token[1:])
    again = (token[:-2] == token[2:]) & (kind[at[:-2]] == _WORD)
    cross = bounds[1:-1] - 2  # the third token is another text's
    again[cross[(cross >= 0) & (cross < len(again))]] = False
    pair[:-1][again] = _AGAIN
    pair[token[:-1] == token[1:]] = _TWICE
    down = np.uint64(64 - bits)
    return (token >> down).astype(np.int64), (pair >> down).astype(np.int64), bounds[:-1], bounds[1:]


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text, a slot once."""
    uni, pair, *_ = ngrams([text], bits)
    slots, counts = np.unique(np.concatenate([uni, pair]), return_counts=True)
    return slots, counts * (SCALE / max(1, counts.sum()))


class Ftrl:
    """FTRL-Proximal for logistic loss: per-coordinate rates, L1 and L2; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _hash(bits: int):
    """Of (text, y, draw, id, h) the rows (y, draw, id, h, slots, x): texts stay where they are, only features move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [features(t.as_py(), bits) for t in part.column(0)]
                slots = pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32()))
                x = pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], slots, x], names=[*part.schema.names[1:], "slots", "x"])

    return run


def _train(bits: int, epochs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for slots, x, y in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                rows.append((np.append(slots.values.to_numpy(), np.int32(1 << bits)), np.append(x.values.to_numpy(), np.float32(1)), y))
        model = Ftrl(1 << bits)
        for _ in range(epochs):
            for at, x, y in rows:
                model.update(at, x, y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["slot", "weight"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    bits: int = BITS,
    epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights by slot, the bias last, from about `sample` labelled rows for which `learn` (of the labels' columns) holds.

    Rows without id or label are left out; a text with several labels counts with each. Without any labelled text all
    weights are 0.
    """
    has_columns(docs, (id_col, text_col))
    has_columns(labels, (id_col, label_col))
    known = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")
    )
    rate = min(1.0, sample / max(1, known.count()))
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(draw < rate)  # `sample` rows but for chance, so it may be broadcast
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = src.join(F.broadcast(chosen), "id").select("text", "y", draw.alias("draw"), "id", F.xxhash64("text").alias("h"))
    id_type = src.schema["id"].dataType.simpleString()
    hashed = rows.transform(in_arrow(_hash(bits), f"y double, draw double, id {id_type}, h long, slots array<int>, x array<float>"))
    ordered = hashed.repartition(1).sortWithinPartitions("draw", "id", "y", "h").select("slots", "x", "y")
    got = ordered.transform(in_arrow(_train(bits, epochs), "slot int, weight double")).toPandas()
    w = np.zeros((1 << bits) + 1)
    w[got["slot"]] = got["weight"]
    return w


def score_texts(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    bits = (len(w) - 1).bit_length() - 1
    out = np.empty(len(texts))
    for i, j in blocks(texts):
        uni, pair, first, last = ngrams(texts[i:j], bits)
        by_token = np.concatenate([[0], np.cumsum(w[uni])])
        by_pair = np.concatenate([[0], np.cumsum(w[pair])])
        n = last - first
        total = by_token[last] - by_token[first]
        total += np.where(n > 1, by_pair[np.maximum(last - 1, 0)] - by_pair[np.minimum(first, len(pair))], 0)
        out[i:j] = w[-1] + SCALE * total / np.maximum(1, n + np.maximum(n - 1, 0))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: <id_col>, the extra columns, score, predicted. Null and empty texts score as the bias alone."""
    has_columns(docs, (id_col, text_col))
    send = docs.sparkSession.sparkContext.broadcast(w)  # 2**bits + 1 numbers
    src = docs.select(F.col(id_col), *extra, F.col(text_col).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(batch.num_columns - 1).to_pylist(), send.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*batch.schema.names[:-1], "score", "predicted"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.transform(in_arrow(run, f"{kept}, score double, predicted int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """Fit on the labels outside the held-out fold (crc32 of the id, modulo 3, is 1) and score every row of docs."""
    w = fit(docs, labels, fold(F.col(id_col), FOLDS) != HELD_OUT, id_col, text_col, label_col, **fitting)
    return score(docs, w, id_col, text_col, ((fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),))


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    """Chance that a row of label 1 scores above one of label 0, ties half."""
    ranks = pd.Series(scores).rank().to_numpy()
    pos = labels == 1
    return float((ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))
