"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased; its distinct strings of 3, 4 and 5 characters (code
points) are hashed into ``2**bits`` features. From labelled texts each feature
gets the log ratio of its smoothed share of toxic and of clean documents;
presence times that ratio is what a logistic regression with L2 penalty is
fitted on. Every feature that a learned text has is in the model; none is left
out. Scoring adds up the weights of the distinct n-grams of the whole text.

The fit reads a bounded sample of labelled rows: at most ``most_toxic`` and
``most_clean`` documents (parameters), those with the smallest hash of their ids,
and of the rows that share an id the one with the least text. Their ids, bounded
by those parameters, are broadcast to the scan; only their texts are shuffled.
Scoring covers every row and every character.

Cases: null or empty texts, and those under three characters, have only the
model's bias; labels that are null, or not 0 or 1, are not learned from, of
several labels of an id the larger counts; with no usable labels, or only one
kind, the score is a smoothed share below 0.5 for all; a null id is scored and
counts as not held out; rows with one id and different texts are scored each by
its text; repeated rows each get their row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

SIZES = (3, 4, 5)
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    """A weight for each of 2**bits features (the ratio is already in it) and a bias."""

    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1


class Features:
    """Distinct features of texts; holds one slot for each feature, to tell which n-grams are met again."""

    def __init__(self, bits: int):
        self.bits, self.slot = bits, np.zeros(1 << bits, np.int32)

    def of(self, text: str) -> np.ndarray:
        """The distinct features of all n-grams of a text."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        h, found = points, []
        for size in range(2, SIZES[-1] + 1):
            if len(points) < size:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ points[size - 1 :]
            if size in SIZES:
                mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)
                found.append(mixed >> np.uint32(32 - self.bits))
        if not found:
            return np.zeros(0, np.uint32)
        every = np.concatenate(found)
        index = np.arange(len(every), dtype=np.int32)
        self.slot[every] = index
        return every[self.slot[every] == index]  # of equal ones the one whose index was kept


def ratios(of_text: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and of clean texts that have a feature; 0 for features that none has."""
    counts = [np.bincount(np.concatenate([f for f, label in zip(of_text, y) if label == c]), minlength=1 << bits) for c in (0, 1)]
    clean, toxic = int((y == 0).sum()), int((y == 1).sum())
    ratio = np.log((counts[1] + 0.5) / (toxic + 1)) - np.log((counts[0] + 0.5) / (clean + 1))
    ratio[counts[0] + counts[1] == 0] = 0
    return ratio


def fit(texts: list[str], labels: list[int], bits: int = 20, penalty: float = 1e-4, rounds: int = 15, rate: float = 0.2) -> Model:
    """Fit on labelled texts."""
    y = np.array(labels, np.float64)
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    if not toxic or not clean:
        share = min(0.49, (toxic + 0.5) / (len(y) + 2))
        return Model(np.zeros(1 << bits, np.float32), math.log(share / (1 - share)))
    features = Features(bits)
    of_text = [features.of(t) for t in texts]
    ratio = ratios(of_text, y, bits)
    squares = ratio * ratio
    scale = math.sqrt(sum(float(squares[f].sum()) for f in of_text) / len(y)) or 1.0
    ratio = (ratio / scale).astype(np.float32)
    chunks = [(k, np.concatenate(of_text[k : k + 256]), np.array([len(f) for f in of_text[k : k + 256]])) for k in range(0, len(y), 256)]
    del of_text
    share = np.where(y == 1, 0.5 / toxic, 0.5 / clean)
    w, b = np.zeros(1 << bits), 0.0
    mw, mb, vw, vb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, rounds + 1):  # Adam over the whole sample
        scaled = (w * ratio).astype(np.float32)
        gw, gb = penalty * w, 0.0
        for k, f, sizes in chunks:
            total = np.concatenate([[0.0], np.cumsum(scaled[f], dtype=np.float64)])[np.cumsum(np.append(0, sizes))]
            error = share[k : k + 256] * (1 / (1 + np.exp(-np.clip(np.diff(total) + b, -30, 30))) - y[k : k + 256])
            gw += np.bincount(f, np.repeat(error, sizes), 1 << bits) * ratio
            gb += float(error.sum())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw * gw, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model((w * ratio).astype(np.float32), b)


def fold(id_col) -> F.Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 2000, most_clean: int = 3000, bits: int = 20) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id") != HELD_OUT)).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.crc32(F.concat_ws("-", F.lit("fit"), "doc_id").cast("binary")), F.col("doc_id")]
    chosen = usable.where("label = 1").orderBy(*order).limit(most_toxic).unionAll(usable.where("label = 0").orderBy(*order).limit(most_clean))
    sample = id_text(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        m = fit([t for _, _, t in rows], [y for _, y, _ in rows], bits)
        at = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([m.weights[at].astype("<f4").tobytes()]), pa.array([m.bias])], names=["features", "weights", "bias"])

    got = sample.repartition(1).mapInArrow(run, "features binary, weights binary, bias double").collect()
    if not got:
        return fit([], [], bits)
    out = Model(np.zeros(1 << bits, np.float32), got[0][2])
    out.weights[np.frombuffer(got[0][0], "<i4")] = np.frombuffer(got[0][1], "<f4")
    return out


def margins(texts: list[str], model: Model, features: Features) -> np.ndarray:
    """Log odds of each text."""
    return np.array([model.bias + float(model.weights[features.of(t)].sum(dtype=np.float64)) for t in texts])


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.bits)
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(margins(batch.column(1).to_pylist(), model, features), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted toxic; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.bits)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(margins(texts, model, features) < 0))

    return df.mapInArrow(run, df.schema)
