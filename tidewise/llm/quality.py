"""Quality classifier: hashed word n-gram logistic regression trained by
follow-the-regularised-leader updates (operator 8).

A text's features are its words, pairs of neighbouring words, and the shapes of
words (kind, all capitals, same as the word before), hashed into 2**BITS
weights; values are counts scaled to length 1. Words are runs of letters, of
digits or of other signs.

Training uses a bounded sample of the labelled rows (FIT_ROWS distinct texts,
whole) in SHARDS groups that are trained side by side, EPOCHS passes each, with
FTRL-proximal updates; the model is the mean of the shards' weights (1 MB, a
constant), which is broadcast. Scoring is a sparse dot product per text in a
map over Arrow batches, without a shuffle.

Defined results: null and empty texts score by the bias alone; without any
labelled row every score is 0.5. Repeated rows get equal scores. Only ``text``
is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import is_held_out, labelled_sample
from .words import buffers, gram_hashes, mix, slices, token_hashes

BITS = 18
FIT_ROWS, SHARDS, EPOCHS = 16_000, 4, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-4
THRESHOLD = 0.7

_U = np.uint64
_MASK = _U((1 << BITS) - 1)
BIAS = 0


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(weight numbers, values) of each text, the bias included."""
    for a, b in slices(texts):
        raw, offsets = buffers(texts.slice(a, b - a))
        words, at, starts, ends = token_hashes(raw, offsets)
        pairs = gram_hashes(words, 2)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        pairs[same[1:]] = _U(0x9E3779B9)  # any word said twice
        upper = (raw >= 65) & (raw <= 90)
        capitals = upper[starts] & upper[ends - 1] & (ends - starts > 1) if len(words) else same
        kind = np.where(raw[starts] < 128, np.where((raw[starts] | 32) >= 97, 1, 2), 1) if len(words) else np.zeros(0, int)
        shapes = mix((kind.astype(np.uint64) << _U(2)) | (capitals.astype(np.uint64) << _U(1)) | same.astype(np.uint64) | _U(1 << 40))
        words, pairs, shapes = words & _MASK, pairs & _MASK, shapes & _MASK
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            found, counts = np.unique(np.concatenate([words[s:e], pairs[s: max(s, e - 1)], shapes[s:e]]), return_counts=True)
            values = counts / max(1.0, np.sqrt(float(counts @ counts)))
            yield np.append(found.astype(np.int64), BIAS), np.append(values, 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """FTRL-proximal weights from one pass order, repeated EPOCHS times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi, ni):
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels):
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i], n[i] = zi + g - sigma * w, ni + g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", held=None) -> np.ndarray:
    """The weights learned from the labelled rows that are not held out."""
    held = is_held_out(F.col("doc_id"), 4, 2) if held is None else held
    sample = labelled_sample(docs, labels, column, held, FIT_ROWS)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        rows = list(features(pa.array(pdf["text"], pa.string())))
        return pd.DataFrame({"w": [train(rows, pdf["label"].tolist()).tobytes()], "n": [len(pdf)]})

    built = sample.withColumn("shard", F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(SHARDS))).groupBy("shard").applyInPandas(shard, "w binary, n long").collect()
    if not built:
        return np.zeros(1 << BITS, np.float32)
    return np.average([np.frombuffer(r["w"], np.float32) for r in built], axis=0, weights=[r["n"] for r in built]).astype(np.float32)


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", held=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = is_held_out(F.col("doc_id"), 4, 2) if held is None else held
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            dots = np.array([w[i] @ x for i, x in features(batch.column(2))])
            p = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
