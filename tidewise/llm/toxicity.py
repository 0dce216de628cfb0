"""Toxicity by nearest labelled examples (operator 1).

Examples and texts are TF-IDF vectors of unit length over the terms that tell
the labels apart. A text's K nearest examples by cosine are found exactly in a
block-max inverted index: every term's postings are grouped by blocks of BLOCK
examples with the block's largest weight; a text's bound for a block is the sum
of its terms' block maxima, blocks are scored from the largest bound down, and
the search ends when no bound left reaches the K-th similarity. Similarities
weigh the votes, which are corrected for the sampling of either label and
smoothed by the rate of the label; the neighbours are returned as evidence.

Bounded parts, all parameters: EXAMPLES labelled texts of either label (distinct,
whole), TERMS terms chosen by chi-square over the examples (CHI_SQUARE at least,
in MIN_EXAMPLES or more). The index is at most EXAMPLES x TERMS postings and is
broadcast. Document frequencies count all
documents. Scoring is a map over Arrow batches; only term counts are shuffled.

Defined results: a text without any chosen term (null and empty ones too) has
no neighbour and gets the rate of the label among such examples; without
labelled rows every score is 0. Ties between examples go to the smaller index.
Only ``text`` is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import is_held_out, labelled_sample
from .words import buffers, slices, token_hashes

EXAMPLES, TERMS, CHI_SQUARE, MIN_EXAMPLES = {1: 1024, 0: 6144}, 2048, 30.0, 5
K, BLOCK, SMOOTHING = 15, 64, 0.5
THRESHOLD = 0.5


def terms(texts: pa.Array, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, counts) of each text; terms are runs of letters.
    ``among``: a sorted vocabulary; some other terms may then be left out."""
    wanted = None
    if among is not None:
        wanted = np.zeros(1 << 18, bool)
        wanted[among & (len(wanted) - 1)] = True
    for a, b in slices(texts):
        raw, offsets = buffers(texts.slice(a, b - a))
        words, at, starts, _ = token_hashes(raw, offsets)
        found, lead = words.view(np.int64), raw[starts]
        use = ((lead | 32) >= 97) & ((lead | 32) <= 122) | (lead >= 128)
        if wanted is not None:
            use &= wanted[found & (len(wanted) - 1)]
        owner = np.repeat(np.arange(b - a), np.diff(at))[use]
        found, cut = found[use], np.searchsorted(owner, np.arange(b - a + 1)).tolist()
        for s, e in zip(cut[:-1], cut[1:]):
            yield np.unique(found[s:e], return_counts=True)


def chosen_terms(examples: DataFrame) -> np.ndarray:
    """The terms that tell the labels apart, at most TERMS, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            found = [(t, np.full(len(t), y)) for (t, _), y in zip(terms(batch.column(0)), labels)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _ in found])), pa.array(np.concatenate([y for _, y in found]).astype(np.int32))], names=["term", "label"])

    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    rows = examples.select("text", "label").mapInArrow(run, "term long, label int")
    counts = rows.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("df"))
    a, b = F.col("a"), F.col("df") - F.col("a")
    c, d, n = F.lit(float(pos)) - a, F.lit(float(neg)) - b, float(pos + neg)
    chi = n * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1.0))
    best = counts.filter(F.col("df") >= MIN_EXAMPLES).withColumn("chi", chi).filter(F.col("chi") >= CHI_SQUARE)
    return np.sort(np.array([r["term"] for r in best.orderBy(F.desc("chi"), "term").limit(TERMS).collect()], np.int64))


def _known(vocabulary: np.ndarray, found: np.ndarray, counts: np.ndarray):
    """(vocabulary numbers, counts) of those terms that are in it."""
    if not len(vocabulary) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == found
    return at[hit], counts[hit].astype(float)


def inverse_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """ln((N + 1) / (df + 1)) + 1 of each chosen term over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for found, counts in terms(batch.column(0), vocabulary):
                df[_known(vocabulary, found, counts)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
    counted = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most TERMS + 1
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], float)
    return np.log((counted.get(-1, 0) + 1) / (df + 1)) + 1


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, vocabulary, idf, vectors, ids, labels, weights):
        self.vocabulary, self.idf = vocabulary, idf
        # similar examples side by side make block maxima tight
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], int(labels[i]), i))
        self.ids, self.labels, self.weights = np.asarray(ids)[order], np.asarray(labels)[order], np.asarray(weights, float)[order]
        sizes = [len(vectors[i][0]) for i in order]
        example = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((example, term))
        self.example, self.weight, term = example[by], weight[by], term[by]
        block = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.first = np.flatnonzero(new)  # first posting of each (term, block)
        self.last = np.append(self.first[1:], len(term))
        self.block = block[self.first]
        self.most = np.maximum.reduceat(self.weight, self.first) if len(self.first) else np.zeros(0)
        self.at = np.searchsorted(term[self.first], np.arange(len(vocabulary) + 1))
        self.blocks = -(-len(order) // BLOCK)
        bare = np.array(sizes) == 0
        rate = lambda m: float((self.weights * self.labels)[m].sum() / self.weights[m].sum()) if self.weights[m].sum() > 0 else 0.0
        self.rate = rate(np.ones(len(order), bool)) if order else 0.0
        self.bare_rate = rate(bare) if bare.any() else self.rate

    def vector(self, found: np.ndarray, counts: np.ndarray):
        at, tf = _known(self.vocabulary, found, counts)
        return unit(at, (1 + np.log(tf)) * self.idf[at])

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities), best first; exact."""
        bound = np.zeros(self.blocks)
        for t, q in zip(at.tolist(), weight.tolist()):
            span = slice(self.at[t], self.at[t + 1])
            bound[self.block[span]] += q * self.most[span]
        order = np.argsort(-bound, kind="stable")
        best, similar = np.zeros(0, np.int64), np.zeros(0)
        for b in order.tolist():
            if bound[b] <= 0 or (len(best) >= k and bound[b] < similar[k - 1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, q in zip(at.tolist(), weight.tolist()):
                i = self.at[t] + np.searchsorted(self.block[self.at[t]: self.at[t + 1]], b)
                if i < self.at[t + 1] and self.block[i] == b:
                    span = slice(self.first[i], self.last[i])
                    score[self.example[span] - b * BLOCK] += q * self.weight[span]
            hit = np.flatnonzero(score > 0)
            best, similar = np.concatenate([best, hit + b * BLOCK]), np.concatenate([similar, score[hit]])
            top = np.lexsort((best, -similar))[:k]
            best, similar = best[top], similar[top]
        return best, similar

    def vote(self, best: np.ndarray, similar: np.ndarray) -> float:
        if not len(best):
            return self.bare_rate
        votes = similar ** 2 * self.weights[best]
        return float((votes @ self.labels[best] + SMOOTHING * self.rate) / (votes.sum() + SMOOTHING))


def unit(at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(weight @ weight)
    return at, weight / norm if norm > 0 else weight


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", held=None) -> Index:
    held = is_held_out(F.col("doc_id"), 5, 0) if held is None else held
    examples = labelled_sample(docs, labels, column, held, EXAMPLES)
    vocabulary = chosen_terms(examples)
    idf = inverse_frequencies(docs, vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [unit(at, (1 + np.log(tf)) * idf[at]) for at, tf in (_known(vocabulary, t, c) for t, c in terms(batch.column(4), vocabulary))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([a.tolist() for a, _ in made], pa.list_(pa.int64())), pa.array([w.tolist() for _, w in made], pa.list_(pa.float64()))],
                names=["doc_id", "h", "label", "n_class", "terms", "weights"])

    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "h", "label", "n_class", "text").mapInArrow(
        vectors, "doc_id long, h long, label int, n_class long, terms array<long>, weights array<double>").orderBy("h").collect()
    taken = pd.Series([r["label"] for r in rows], dtype="int64").value_counts()
    weights = np.array([r["n_class"] / taken[r["label"]] for r in rows])
    return Index(vocabulary, idf, [(np.array(r["terms"], np.int64), np.array(r["weights"], float)) for r in rows],
                 np.array([r["doc_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), weights / max(weights.mean(), 1e-300) if len(weights) else weights)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,label:int>>"


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", held=None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    held = is_held_out(F.col("doc_id"), 5, 0) if held is None else held
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column, held))
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            p, near = [], []
            for found, counts in terms(batch.column(2), index.vocabulary):
                best, similar = index.nearest(*index.vector(found, counts))
                p.append(index.vote(best, similar))
                near.append([{"doc_id": i, "similarity": s, "label": y} for i, s, y in zip(index.ids[best].tolist(), similar.tolist(), index.labels[best].tolist())])
            p = np.array(p, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(near, evidence)],
                                             names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
