"""Approximate nearest neighbours by largest inner product with a hierarchical
navigable small-world graph per shard (operator 9).

Vectors are dealt to shards of about SHARD_ROWS by a hash of their id; a task
builds a shard's graph and stores it as flat arrays (vectors, neighbour lists
per level) in one row of a table in the shared folder, so an index is built
once, survives lost executors and is searched by any number of tasks. Queries
are packed in blocks and go to every shard of their dimension; shard results
are merged by exact score.

Within a graph, vectors get one more coordinate that makes their lengths equal,
which turns the largest inner product into the nearest neighbour. Equal vectors
of a shard are one node that carries their ids (the smallest ones that a query
could return), so a vector that is a third of the table is one node per shard.

Defined results: vectors that are null, zero or hold a null or a non-finite
component take no part; rows without an id neither; of rows that repeat an id,
any one counts. Vectors of another dimension are never compared. Ties go to the
smaller id. An empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

SHARD_ROWS, QUERY_BLOCK = 4096, 2048
#: Queries of a block that are searched side by side.
HOP_QUERIES = 128
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 96
EVERY, TOP = 20, 20


class Graph:
    """One shard's graph. ``links[l]`` has a row of neighbours per node of
    level l, padded with -1; ``place[l]`` gives a node's row there."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        n = len(vectors)
        self.raw = vectors
        length = np.einsum("ij,ij->i", vectors, vectors)
        self.vectors = np.hstack([vectors, np.sqrt(np.maximum(length.max(initial=0) - length, 0))[:, None]])
        levels = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.top = int(levels.max(initial=0))
        self.near: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(self.top + 1)]
        self.start, reached = 0, -1
        for i in range(n):
            self._insert(i, int(levels[i]), reached)
            if levels[i] > reached:
                self.start, reached = i, int(levels[i])

    def _search(self, q, starts: list[int], width: int, neighbours, vectors) -> list[tuple[float, int]]:
        """The best ``width`` nodes found, as (similarity, node), best first."""
        seen = set(starts)
        found = [(float(vectors[s] @ q), s) for s in starts]
        best = list(found)
        heapq.heapify(best)
        todo = [(-s, i) for s, i in found]
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [j for j in neighbours(i) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for t, j in zip((vectors[new] @ q).tolist(), new):
                if len(best) < width:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(todo, (-t, j))
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of the found nodes, those nearer to the new one than to one already
        taken; filled up with the nearest others."""
        nodes = [j for _, j in found]
        if len(nodes) <= most:
            return nodes
        v = self.vectors[nodes]
        among = v @ v.T
        taken: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(taken) < most and (not taken or among[k, taken].max() < s):
                taken.append(k)
        chosen = set(taken)
        taken += [k for k in range(len(nodes)) if k not in chosen][: most - len(taken)]
        return [nodes[k] for k in taken]

    def _insert(self, i: int, level: int, reached: int) -> None:
        if reached < 0:
            return
        q, at = self.vectors[i], [self.start]
        for layer in range(reached, level, -1):
            at = [self._search(q, at, 1, self.near[layer].__getitem__, self.vectors)[0][1]]
        for layer in range(min(level, reached), -1, -1):
            near, most = self.near[layer], LINKS * (2 if layer == 0 else 1)
            found = self._search(q, at, BUILD_WIDTH, near.__getitem__, self.vectors)
            near[i] = self._spread(found, LINKS)
            for j in near[i]:
                near[j].append(i)
                if len(near[j]) > most + LINKS // 2:
                    s = self.vectors[near[j]] @ self.vectors[j]
                    near[j] = self._spread(sorted(zip(s.tolist(), near[j]), reverse=True), most)
            at = [j for _, j in found]

    def flat(self) -> dict[str, bytes | int]:
        """The graph as flat arrays."""
        width = [max(1, max((len(x) for x in near), default=1)) for near in self.near]
        links = [np.array([x + [-1] * (w - len(x)) for x in near], np.int32) for near, w in zip(self.near, width)]
        return {"start": self.start, "widths": np.array(width, np.int32).tobytes(), "links": b"".join(x.tobytes() for x in links), "vectors": self.raw.astype(np.float64).tobytes()}


class Searcher:
    """Searches a graph stored as flat arrays, for many queries a hop at a time."""

    def __init__(self, start: int, widths: bytes, links: bytes, vectors: bytes, dim: int):
        self.start = start
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        n, flat, at = len(self.vectors), np.frombuffer(links, np.int32), 0
        self.near = []
        for w in np.frombuffer(widths, np.int32).tolist():
            self.near.append(flat[at: at + n * w].reshape(n, w))
            at += n * w

    def _beams(self, queries: np.ndarray, at: np.ndarray, width: int, links: np.ndarray) -> np.ndarray:
        """The best ``width`` nodes found for each query from its node ``at``,
        best first, -1 where there are fewer. A hop takes every query's best
        node that was not followed yet; a query ends when all it holds were."""
        every = np.arange(len(queries))
        held = np.full((len(queries), width), -2)  # twice the node, and 1 if it is to be followed
        score = np.full((len(queries), width), -np.inf)
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        held[:, 0], seen[every, at] = 2 * at + 1, True
        score[:, 0] = np.einsum("ij,ij->i", self.vectors[at], queries)
        rows = every
        while True:
            best = np.where(held[rows] & 1, score[rows], -np.inf).argmax(axis=1)
            follow = held[rows, best]
            going = (follow & 1).astype(bool)
            rows, best, follow = rows[going], best[going], follow[going] >> 1
            if not len(rows):
                break
            held[rows, best] -= 1
            near = links[follow]
            of, place = np.nonzero((near >= 0) & ~seen[rows[:, None], near])
            nodes = near[of, place]
            seen[rows[of], nodes] = True
            gained = np.einsum("ij,ij->i", self.vectors[nodes], queries[rows[of]])
            better = gained > score[rows].min(axis=1)[of]
            of, nodes, gained = of[better], nodes[better], gained[better]
            # the gains of a query beside what it holds, as many columns as the most that one has
            some, of, many = np.unique(of, return_inverse=True, return_counts=True)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            own, more = rows[some], max(many, default=0)
            if not more:
                continue
            codes, scores = np.full((len(some), width + more), -2), np.full((len(some), width + more), -np.inf)
            codes[:, :width], scores[:, :width] = held[own], score[own]
            codes[of, width + place], scores[of, width + place] = 2 * nodes + 1, gained
            keep = scores.argpartition(more - 1, axis=1)[:, more:]
            held[own], score[own] = np.take_along_axis(codes, keep, 1), np.take_along_axis(scores, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(held >> 1, order, 1)

    def nearest(self, queries: np.ndarray, width: int) -> np.ndarray:
        """A row of up to ``width`` nodes per query, best first, filled up with -1."""
        at = np.full(len(queries), self.start)
        for near in self.near[:0:-1]:
            at = self._beams(queries, at, 1, near)[:, 0]
        return self._beams(queries, at, width, self.near[0])


def valid_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles), dim of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def build(rows: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: dim, shard, and a graph with its ids as flat arrays per row."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.col("dim") == dim, F.lit(-(-n // shard_rows))).otherwise(shards)

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("vec_id").sort_values("vec_id")
        vectors = np.array(pdf["v"].tolist(), np.float64)
        nodes, of = np.unique(vectors, axis=0, return_inverse=True)
        ids = pdf["vec_id"].to_numpy()
        order = np.argsort(of.reshape(-1), kind="stable")
        first = np.searchsorted(of.reshape(-1)[order], np.arange(len(nodes) + 1))
        # a query returns at most top ids of one vector, besides its own
        kept = [ids[order[a: min(b, a + top + 1)]] for a, b in zip(first[:-1], first[1:])]
        shuffled = np.random.default_rng(11).permutation(len(nodes))
        flat = Graph(nodes[shuffled]).flat()
        kept = [kept[i] for i in shuffled]
        return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), **flat,
                              "ids": np.concatenate(kept).astype(np.int64).tobytes(), "counts": np.array([len(k) for k in kept], np.int32).tobytes()}])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards).cast("int"))
    return stored(dealt.groupBy("dim", "shard").applyInPandas(
        graph, "dim int, shard int, start int, widths binary, links binary, vectors binary, ids binary, counts binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest, itself left out."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]),
                              "query_ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "query_vectors": np.array(pdf["v"].tolist(), np.float64).tobytes()}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                searcher = Searcher(r.start, r.widths, r.links, r.vectors, r.dim)
                ids, counts = np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int32)
                at = np.append(0, np.cumsum(counts))
                out: list[tuple[int, int, float]] = []
                queries, vectors = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.query_vectors, np.float64).reshape(-1, r.dim)
                for a in range(0, len(queries), HOP_QUERIES):
                    found = searcher.nearest(vectors[a: a + HOP_QUERIES], max(width, top + 1))
                    for query, q, nodes in zip(queries[a: a + HOP_QUERIES].tolist(), vectors[a: a + HOP_QUERIES], found):
                        nodes = nodes[nodes >= 0]
                        scores = (searcher.vectors[nodes] * q).sum(axis=1).tolist()
                        hits = [(s, j) for s, i in zip(scores, nodes.tolist()) for j in ids[at[i]: at[i + 1]].tolist() if j != query]
                        hits.sort(key=lambda x: (-x[0], x[1]))
                        out += [(query, j, s) for s, j in hits[:top]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    count = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(count)).cast("int"))
    blocks = blocks.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, query_ids binary, query_vectors binary")
    # every query meets every shard of its dimension, a block and a shard at a time
    pairs = index.join(stored(blocks, "ann-queries"), "dim").repartition("dim", "shard", "block")
    found = pairs.select("dim", "start", "widths", "links", "vectors", "ids", "counts", "query_ids", "query_vectors").mapInPandas(run, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """The ``top`` nearest of each vector whose id is divisible by ``every``."""
    rows = stored(valid_vectors(table), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return search(build(rows, top), queries, top)
