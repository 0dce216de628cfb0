"""Random forest fitted on every row of a table of any length.

Spark's forest keeps all nodes on the driver, and an unbounded tree has nodes in
proportion to its rows. Here no step holds a whole tree of a large table:

1. Features become codes of one byte: up to BINS distinct values each have their
   own, else cuts are quantiles of all rows, each class by its weight. The rows
   are stored once in blocks of BLOCK_ROWS rows of codes.
2. A node that more than SUBTREE_ROWS draws reach is split by a pass over all
   blocks: every task counts (node, feature, code, class) and the counts meet by
   tree. These upper nodes, a few hundred a tree, are on the driver.
3. The rows that reach a smaller node meet in one task, packed, which grows the
   whole subtree level by level in array operations. Subtrees are a table.
4. Scoring sends packed rows to the subtrees they reach, CHUNK blocks at once, and
   adds the votes by block.

As in Spark's forest, every tree draws each row Poisson(1) times, a node tries
ceil(sqrt(d)) features drawn at random, the cut with the largest decrease of the
weighted Gini impurity is taken, leaves below one node that predict the same class
are merged, and a row's class is that of the largest sum of class shares. Trees
depend on how the rows are dealt to blocks, but not on the order in which rows of
a subtree arrive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.session import discard, materialize

BINS = 32
CODE_BITS = 5
BLOCK_ROWS = 65_536
#: Draws of one node from which on it is split by a pass over all rows.
SUBTREE_ROWS = 300_000
#: Rows times trees that are on their way to the subtrees at once.
SHIPPED_ROWS = 200_000_000
#: Blocks whose rows may meet in one task of the scoring, and bytes of blocks a task reads.
CHUNK = 32
TASK_BYTES = 64 << 20
#: Steps of the quantile grid, and classes at most (as in Spark's forest).
GRID = 256
CLASSES = 100
#: Decrease of impurity, as a share of a node's weight, that is only rounding.
ROUNDING = 1e-12


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit_cuts(rows: DataFrame, d: int, mass: dict[float, float]) -> list[np.ndarray]:
    """The cuts of each of d features from all rows (x, label): between all values
    of a feature that has at most BINS, else quantiles, each class having ``mass``."""
    def distinct(batches):
        seen: list = [np.zeros(0)] * d
        for b in batches:
            x = _matrix(b.column("x"), d)
            for i in range(d):
                if seen[i] is not None:
                    both = np.union1d(seen[i], x[:, i])
                    seen[i] = both if len(both) <= BINS else None
        yield pa.RecordBatch.from_pydict({"f": pa.array(range(d), pa.int32()),
                                          "v": pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))})

    values: list = [np.zeros(0)] * d
    for r in rows.select("x").mapInArrow(distinct, "f int, v array<double>").collect():
        if values[r.f] is not None:
            both = None if r.v is None else np.union1d(values[r.f], r.v)
            values[r.f] = both if both is not None and len(both) <= BINS else None
    many = [i for i in range(d) if values[i] is None]
    if many:
        grid = [j / GRID for j in range(GRID + 1)]
        found = rows.groupBy("label").agg(*[F.percentile_approx(F.col("x")[i], grid, 20_000).alias(f"q{i}") for i in many]).collect()
        for i in many:
            v = np.concatenate([r[f"q{i}"] for r in found])
            share = np.concatenate([np.full(GRID + 1, mass[r.label]) for r in found])
            order = np.argsort(v, kind="stable")
            v, share = v[order], np.cumsum(share[order])
            kept = np.unique(v)[:-1]
            if len(kept) > BINS - 1:
                places = np.searchsorted(share, share[-1] * np.arange(1, BINS) / BINS)
                kept = np.setdiff1d(v[places], v[-1:])
            values[i] = kept
    out = []
    for i, v in enumerate(values):
        if i not in many:  # half way between neighbours
            with np.errstate(over="ignore", invalid="ignore"):
                half = v[:-1] + (v[1:] - v[:-1]) / 2
            v = np.where(np.isfinite(half), half, v[:-1])
        out.append(v)
    return out


def _blocks(rows: DataFrame, tag: str, dtype: str, cuts: list[np.ndarray], name: str) -> DataFrame:
    """block, n, codes (n x d bytes), tag (n values of ``dtype``): the rows (x, tag) packed."""
    d = len(cuts)

    def pack(batches):
        codes, tags, held = [], [], 0

        def packed():
            c, t = np.concatenate(codes), np.concatenate(tags)
            for a in range(0, len(c), BLOCK_ROWS):
                part = c[a: a + BLOCK_ROWS]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(part)], pa.int32()), "codes": pa.array([part.tobytes()], pa.binary()),
                                                  "tag": pa.array([t[a: a + BLOCK_ROWS].tobytes()], pa.binary())})

        for b in batches:
            x = _matrix(b.column("x"), d)
            codes.append(np.column_stack([np.searchsorted(cuts[i], x[:, i]).astype(np.uint8) for i in range(d)]) if len(x) else np.zeros((0, d), np.uint8))
            tags.append(b.column(tag).to_numpy(zero_copy_only=False).astype(dtype))
            held += len(x)
            if held >= BLOCK_ROWS:
                yield from packed()
                codes, tags, held = [], [], 0
        if held:
            yield from packed()

    out = rows.select("x", tag).mapInArrow(pack, "n int, codes binary, tag binary")
    return materialize(out.withColumn("block", F.monotonically_increasing_id()), name)


def _spread(blocks: DataFrame, rows: int, d: int) -> DataFrame:
    """Few tasks, as each sends counts of every node, but of TASK_BYTES at most."""
    return blocks.coalesce(max(2 * blocks.sparkSession.sparkContext.defaultParallelism, rows * (d + 8) // TASK_BYTES))


def _read(batches, d: int, dtype: str):
    """(block, codes, tags) of each block."""
    for b in batches:
        for block, codes, tag in zip(b.column("block"), b.column("codes"), b.column("tag")):
            yield block.as_py(), np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, d), np.frombuffer(tag.as_buffer(), dtype)


def drawn(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8)


def walk(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The last node that each row reaches from node 0."""
    node = np.zeros(len(codes), np.int64)
    moving = np.arange(len(codes))
    while len(moving):
        f = feature[node[moving]]
        moving, f = moving[f >= 0], f[f >= 0]
        at = node[moving]
        node[moving] = left[at] + (codes[moving, f] > cut[at])
    return node


def _decrease(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Decrease of Gini impurity times the node's weight; class weights on the last
    axis. 0 where a side is empty."""
    right = total - left
    a, b, t = left.sum(-1), right.sum(-1), total.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(-1) / a + (right * right).sum(-1) / b - (total * total).sum(-1) / t
    return np.where((a > 0) & (b > 0) & (gain > ROUNDING * t), gain, 0.0)


def _features(rng, nodes: int, d: int) -> np.ndarray:
    """ceil(sqrt(d)) different features of each node."""
    k = math.ceil(math.sqrt(d))
    return np.argpartition(rng.random((nodes, d)), k - 1, axis=1)[:, :k]


def _best_dense(key: np.ndarray, n: np.ndarray, counts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decrease, cut) of each node, key = (node * BINS + code) * classes + class."""
    nodes, k = counts.shape
    held = np.bincount(key, weights=n, minlength=nodes * BINS * k).reshape(nodes, BINS, k)
    gain = _decrease(held.cumsum(axis=1)[:, :-1] * w, (counts * w)[:, None, :])
    cut = gain.argmax(axis=1)
    return gain[np.arange(nodes), cut], cut


def _best_sorted(node: np.ndarray, code: np.ndarray, label: np.ndarray, n: np.ndarray, counts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small nodes: cells are runs of the sorted rows."""
    nodes, k = counts.shape
    packed = (((node << CODE_BITS | code) << 7 | label) << 8) | n
    packed.sort()
    cell, cls, times = packed >> 15, (packed >> 8) & 127, packed & 255
    last = np.flatnonzero(cell[1:] != cell[:-1])
    at, code = cell[last] >> CODE_BITS, cell[last] & (BINS - 1)
    before = np.cumsum(counts, axis=0) - counts  # draws of the nodes before
    left = np.stack([(np.cumsum(np.where(cls == q, times, 0))[last] - before[at, q]) * w[q] for q in range(k)], axis=1)
    gain = _decrease(left, counts[at] * w)
    best, cut = np.zeros(nodes), np.zeros(nodes, np.int64)
    if len(at):
        firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        best[at[firsts]] = np.maximum.reduceat(gain, firsts)
        top = np.flatnonzero(gain == best[at])[::-1]  # the lowest of equal cuts is written last
        cut[at[top]] = code[top]
    return best, cut


@dataclass
class Nodes:
    """A tree or subtree: node i goes to left[i] where its feature's code is at most
    cut[i], else to left[i] + 1; feature -1 is a leaf. held: weight of each class."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    held: np.ndarray
    gain: np.ndarray

    def merge(self, nodes: np.ndarray, leaf: np.ndarray, predicted: np.ndarray) -> None:
        """Make a leaf of each of ``nodes`` whose two children are leaves of one class."""
        inner = nodes[self.feature[nodes] >= 0]
        a = self.left[inner]
        same = inner[leaf[a] & leaf[a + 1] & (predicted[a] == predicted[a + 1])]
        self.feature[same], leaf[same] = -1, True

    def reached(self, levels: list[np.ndarray]) -> np.ndarray:
        reach = np.zeros(len(self.feature), bool)
        reach[0] = True
        for nodes in levels:
            inner = nodes[reach[nodes] & (self.feature[nodes] >= 0)]
            reach[self.left[inner]] = reach[self.left[inner] + 1] = True
        return reach

    def importance(self, d: int, of: np.ndarray) -> np.ndarray:
        inner = of & (self.feature >= 0)
        return np.bincount(self.feature[inner], weights=self.gain[inner], minlength=d)


def grow(codes: np.ndarray, label: np.ndarray, n: np.ndarray, w: np.ndarray, depth: int, rng) -> Nodes:
    """The tree of at most ``depth`` levels below its root over rows drawn ``n`` times, merged."""
    d, k = codes.shape[1], len(w)
    flat, label, n = codes.ravel(), label.astype(np.int64), n.astype(np.int64)
    rows, slot, nodes, base = np.arange(len(label)), np.zeros(len(label), np.int64), 1, 0
    parts: list[Nodes] = []
    while True:
        counts = np.bincount(slot * k + label[rows], weights=n[rows], minlength=nodes * k).astype(np.int64).reshape(nodes, k)
        own = Nodes(np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int32), counts * w, np.zeros(nodes))
        parts.append(own)
        mixed = (counts > 0).sum(axis=1) > 1
        if len(parts) > depth or not mixed.any():
            break
        keep = mixed[slot]
        rows, slot = rows[keep], (np.cumsum(mixed) - 1)[slot[keep]]
        counts, some = counts[mixed], int(mixed.sum())
        tried = _features(rng, some, d)
        best, where, cut = np.zeros(some), np.zeros(some, np.int64), np.zeros(some, np.int64)
        y, times = label[rows], n[rows]
        for j in range(tried.shape[1]):
            code = flat[rows * d + tried[slot, j]].astype(np.int64)
            if some * BINS * k <= len(rows):
                gain, at = _best_dense((slot * BINS + code) * k + y, times, counts, w)
            else:
                gain, at = _best_sorted(slot, code, y, times, counts, w)
            better = gain > best
            best, where, cut = np.where(better, gain, best), np.where(better, tried[:, j], where), np.where(better, at, cut)
        split = best > 0
        if not split.any():
            break
        ids = np.flatnonzero(mixed)[split]
        own.feature[ids], own.cut[ids], own.gain[ids] = where[split], cut[split], best[split]
        own.left[ids] = base + nodes + 2 * np.arange(len(ids))
        keep = split[slot]
        rows, slot = rows[keep], slot[keep]
        slot = 2 * (np.cumsum(split) - 1)[slot] + (flat[rows * d + where[slot]] > cut[slot])
        base, nodes = base + nodes, 2 * len(ids)
    tree = Nodes(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("feature", "cut", "left", "held", "gain")))
    ends = np.cumsum([0] + [len(p.feature) for p in parts])
    levels = [np.arange(a, b) for a, b in zip(ends[:-1], ends[1:])]
    predicted = tree.held.argmax(axis=1)
    for level in reversed(levels):
        tree.merge(level, tree.feature < 0, predicted)
    kept = tree.reached(levels)
    left = (np.cumsum(kept) - 1)[np.where(tree.feature >= 0, tree.left, 0)].astype(np.int32)
    return Nodes(tree.feature[kept], tree.cut[kept], left[kept], tree.held[kept], tree.gain[kept])


def _shares(held: np.ndarray) -> np.ndarray:
    return (held / held.sum(axis=1, keepdims=True)).astype(np.float32)


#: Nodes of the upper part of a tree: split, still to be split, a leaf, the root of a stored subtree.
SPLIT, OPEN, LEAF, STORED = range(4)


@dataclass
class _Upper:
    """The upper part of a tree; kinds and depths of its nodes."""
    nodes: Nodes
    kind: np.ndarray
    depth: np.ndarray

    @classmethod
    def root(cls, k: int) -> _Upper:
        return cls(Nodes(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros((1, k)), np.zeros(1)),
                   np.array([OPEN], np.uint8), np.zeros(1, np.int16))

    def split(self, found: np.ndarray, w: np.ndarray, depth: int) -> None:
        """Apply a level: gain, feature, cut, draws of each class, those to the left, of each open node."""
        k, t = len(w), self.nodes
        for i, (gain, feature, cut, *draws) in zip(np.flatnonzero(self.kind == OPEN), found):
            own, left = np.array(draws[:k]), np.array(draws[k:])
            t.held[i] = own * w
            self.kind[i] = SPLIT if gain > 0 else LEAF
            if gain <= 0:
                continue
            t.feature[i], t.cut[i], t.gain[i], t.left[i] = feature, cut, gain, len(t.feature)
            for side in (left, own - left):
                kind = LEAF if (side > 0).sum() < 2 or self.depth[i] + 1 >= depth else OPEN if side.sum() > SUBTREE_ROWS else STORED
                t.feature, t.cut, t.left = np.append(t.feature, np.int16(-1)), np.append(t.cut, np.uint8(0)), np.append(t.left, np.int32(0))
                t.held, t.gain = np.vstack([t.held, side * w]), np.append(t.gain, 0.0)
                self.kind, self.depth = np.append(self.kind, np.uint8(kind)), np.append(self.depth, np.int16(self.depth[i] + 1))


def _by_node(node: np.ndarray, rows: np.ndarray):
    """(node, its rows) of all nodes in ``node``."""
    order = np.argsort(node, kind="stable")
    node, rows = node[order], rows[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
    for a, b in zip(starts, [*starts[1:], len(node)]):
        yield int(node[a]), rows[a:b]


def _level(blocks: DataFrame, uppers: dict[int, _Upper], w: np.ndarray, d: int, seed: int, depth: int) -> None:
    """Split every open node of the trees, from one pass over all rows."""
    k = len(w)
    work = {}
    for t, u in uppers.items():
        open_ = np.flatnonzero(u.kind == OPEN)
        if len(open_):
            place = np.full(len(u.kind), -1, np.int64)
            place[open_] = np.arange(len(open_))
            tried = np.concatenate([_features(np.random.default_rng([seed, t, int(i)]), 1, d) for i in open_])
            work[t] = (u.nodes.feature, u.nodes.cut, u.nodes.left, place, tried)

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for block, codes, label in _read(batches, d, "uint8"):
            for t, (feature, cut, left, place, tried) in work.items():
                n = drawn(seed, t, block, len(codes))
                own = codes[n > 0]
                slot, y, n = place[walk(own, feature, cut, left)], label[n > 0].astype(np.int64), n[n > 0]
                keep = slot >= 0
                own, slot, y, n = own[keep], slot[keep], y[keep], n[keep]
                size = len(tried) * BINS * k
                new = np.concatenate([np.bincount((slot * BINS + own[np.arange(len(own)), tried[slot, j]]) * k + y, weights=n, minlength=size)
                                      for j in range(tried.shape[1])])
                held[t] = held[t] + new if t in held else new
        for t, v in held.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "held": pa.array([v.tobytes()], pa.binary())})

    def choose(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        tried = work[t][4]
        held = sum(np.frombuffer(v.as_py()) for v in table.column("held")).reshape(tried.shape[1], len(tried), BINS, k)
        own = held[0].sum(axis=1)
        left = held.cumsum(axis=2)[:, :, :-1]
        gain = _decrease(left * w, (own * w)[None, :, None, :])
        node = np.arange(len(tried))
        cut = gain.argmax(axis=2)
        best = np.take_along_axis(gain, cut[:, :, None], 2)[:, :, 0]
        j = best.argmax(axis=0)
        out = np.column_stack([best[j, node], tried[node, j], cut[j, node], own, left[j, node, cut[j, node]]])
        return pa.table({"tree": pa.array([t], pa.int32()), "found": pa.array([out.tobytes()], pa.binary())})

    counted = blocks.mapInArrow(count, "tree int, held binary")
    for r in counted.groupBy("tree").applyInArrow(choose, "tree int, found binary").collect():
        uppers[r.tree].split(np.frombuffer(r.found).reshape(-1, 3 + 2 * k), w, depth)


_SUBTREE = "tree int, node int, feature binary, cut binary, left binary, held binary, size int, predicted int, importance binary"


def _subtrees(blocks: DataFrame, uppers: dict[int, _Upper], w: np.ndarray, d: int, seed: int, depth: int) -> DataFrame:
    """The subtrees below the upper parts, grown and stored."""
    work = {t: (u.nodes.feature, u.nodes.cut, u.nodes.left, u.kind == STORED, u.depth) for t, u in uppers.items()}

    def send(batches):
        for block, codes, label in _read(batches, d, "uint8"):
            for t, (feature, cut, left, stored, _) in work.items():
                n = drawn(seed, t, block, len(codes))
                rows = np.flatnonzero(n)
                node = walk(codes[rows], feature, cut, left)
                keep = stored[node]
                sent = [(i, codes[r].tobytes(), label[r].tobytes(), n[r].tobytes()) for i, r in _by_node(node[keep], rows[keep])]
                if sent:
                    nodes, *cells = zip(*sent)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(sent), pa.int32()), "node": pa.array(nodes, pa.int32()),
                                                      **{c: pa.array(v, pa.binary()) for c, v in zip(("codes", "label", "n"), cells)}})

    def build(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        codes, label, n = (np.frombuffer(b"".join(v.as_py() for v in table.column(c)), np.uint8) for c in ("codes", "label", "n"))
        sub = grow(codes.reshape(-1, d), label, n, w, depth - int(work[t][4][node]), np.random.default_rng([seed, t, node, 1]))
        cells = {"feature": sub.feature, "cut": sub.cut, "left": sub.left, "held": _shares(sub.held),
                 "importance": sub.importance(d, np.ones(len(sub.feature), bool))}
        numbers = {"tree": t, "node": node, "size": len(sub.feature), "predicted": int(sub.held[0].argmax())}
        return pa.table({c: pa.array([numbers[c]], pa.int32()) if c in numbers else pa.array([cells[c].tobytes()], pa.binary())
                         for c in (f.split()[0] for f in _SUBTREE.split(", "))})

    sent = blocks.mapInArrow(send, "tree int, node int, codes binary, label binary, n binary")
    return materialize(sent.groupBy("tree", "node").applyInArrow(build, _SUBTREE), "forest-trees")


@dataclass
class StoredForest:
    """Upper parts of the trees and the tables of their subtrees, one table for each
    group of trees. ``transform`` runs jobs, as rows have to meet the subtrees."""
    cuts: list[np.ndarray]
    classes: int
    group: int
    #: Rows that the forest was fitted on.
    rows: int = 0
    uppers: list[_Upper] = field(default_factory=list, repr=False)
    tables: list[DataFrame] = field(default_factory=list, repr=False)
    totalNumNodes: int = 0
    featureImportances: DenseVector | None = None

    def _finish(self, stats: dict[tuple[int, int], tuple]) -> None:
        """Merge upper leaves of one class, and sum up sizes and importances."""
        d = len(self.cuts)
        total, self.totalNumNodes = np.zeros(d), 0
        for t, u in enumerate(self.uppers):
            nodes, count = u.nodes, len(u.kind)
            leaf, predicted = u.kind == LEAF, nodes.held.argmax(axis=1)
            for i in np.flatnonzero(u.kind == STORED):
                leaf[i], predicted[i] = stats[t, i][0] == 1, stats[t, i][1]
            for i in reversed(range(count)):
                nodes.merge(np.array([i]), leaf, predicted)
            u.kind[(u.kind == SPLIT) & (nodes.feature < 0)] = LEAF
            reach = nodes.reached([np.array([i]) for i in range(count)])
            own = nodes.importance(d, reach)
            self.totalNumNodes += int(reach.sum())
            for i in np.flatnonzero(reach & (u.kind == STORED)):
                own = own + stats[t, i][2]
                self.totalNumNodes += stats[t, i][0] - 1
            total += own / own.sum() if own.sum() else 0.0
        self.featureImportances = Vectors.dense(total / total.sum() if total.sum() else total)

    def _votes(self, blocks: DataFrame, g: int) -> DataFrame:
        """block, votes (rows x classes): the votes of a group of trees, stored."""
        d, k = len(self.cuts), self.classes
        work = {t: (u.nodes.feature, u.nodes.cut, u.nodes.left, u.kind == STORED, _shares(u.nodes.held))
                for t, u in enumerate(self.uppers) if t // self.group == g}
        sent = "tree int, node int, chunk long, block long, place binary, codes binary"

        def send(batches):
            for block, codes, _ in _read(batches, d, "int64"):
                votes = np.zeros((len(codes), k), np.float32)
                for t, (feature, cut, left, stored, shares) in work.items():
                    node = walk(codes, feature, cut, left)
                    keep = stored[node]
                    votes[~keep] += shares[node[~keep]]
                    parts = [(i, r.astype(np.uint32).tobytes(), codes[r].tobytes()) for i, r in _by_node(node[keep], np.flatnonzero(keep))]
                    if parts:
                        nodes, places, cells = zip(*parts)
                        yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(parts), pa.int32()), "node": pa.array(nodes, pa.int32()),
                                                          "chunk": pa.array([chunks[block]] * len(parts), pa.int64()), "block": pa.array([block] * len(parts), pa.int64()),
                                                          "place": pa.array(places, pa.binary()), "codes": pa.array(cells, pa.binary())})
                every = np.arange(len(codes), dtype=np.uint32)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([-1], pa.int32()), "node": pa.array([-1], pa.int32()), "chunk": pa.array([0], pa.int64()),
                                                  "block": pa.array([block], pa.int64()), "place": pa.array([every.tobytes()], pa.binary()),
                                                  "codes": pa.array([votes.tobytes()], pa.binary())})

        def follow(rows: pa.Table, trees: pa.Table) -> pa.Table:
            block, place, votes = [], [], []
            if len(rows):
                sub = trees.slice(0, 1).to_pylist()[0]
                feature, cut, left, shares = (np.frombuffer(sub[c], v) for c, v in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("held", np.float32)))
                shares = shares.reshape(-1, k)
                for b, p, c in zip(rows.column("block"), rows.column("place"), rows.column("codes")):
                    block.append(b.as_py())
                    place.append(p.as_py())
                    votes.append(shares[walk(np.frombuffer(c.as_py(), np.uint8).reshape(-1, d), feature, cut, left)].tobytes())
            return pa.table({"block": pa.array(block, pa.int64()), "place": pa.array(place, pa.binary()), "votes": pa.array(votes, pa.binary())})

        ids = sorted(r.block for r in blocks.select("block").collect())
        chunks = {b: i // CHUNK for i, b in enumerate(ids)}
        routed = materialize(blocks.mapInArrow(send, sent), "forest-routed")
        trees = self.tables[g].crossJoin(blocks.sparkSession.range((len(ids) - 1) // CHUNK + 1).withColumnRenamed("id", "chunk"))
        keys = ("tree", "node", "chunk")
        followed = (routed.filter("tree >= 0").groupBy(*keys)
                    .cogroup(trees.select(*keys, "feature", "cut", "left", "held").groupBy(*keys))
                    .applyInArrow(follow, "block long, place binary, votes binary"))
        votes = followed.unionByName(routed.filter("tree < 0").select("block", "place", F.col("codes").alias("votes")))

        def add(table: pa.Table) -> pa.Table:
            places = [np.frombuffer(p.as_py(), np.uint32) for p in table.column("place")]
            out = np.zeros((1 + max(int(p.max()) for p in places), k))
            for p, v in zip(places, table.column("votes")):
                out[p] += np.frombuffer(v.as_py(), np.float32).reshape(-1, k)  # places of a record differ
            return pa.table({"block": table.column("block").slice(0, 1), "votes": pa.array([out.tobytes()], pa.binary())})

        summed = materialize(votes.groupBy("block").applyInArrow(add, "block long, votes binary"), "forest-votes")
        discard(routed)
        return summed

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction`` from its vector column ``features``."""
        k, id_ = self.classes, "_forest_row"
        rows = materialize(df.withColumn(id_, F.monotonically_increasing_id()), "forest-rows")
        n = rows.count()
        if not n:
            return rows.drop(id_).withColumn("prediction", F.lit(0.0))
        blocks = _blocks(rows.select(vector_to_array("features").alias("x"), id_), id_, "int64", self.cuts, "forest-blocks")
        spread = _spread(blocks, n, len(self.cuts))
        votes = [self._votes(spread, g) for g in range(len(self.tables))]
        every = votes[0]
        for v in votes[1:]:
            every = every.unionByName(v)

        def decide(own: pa.Table, votes: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in votes.column("votes")).reshape(-1, k)
            return pa.table({id_: pa.array(np.frombuffer(own.column("tag")[0].as_py(), np.int64)),
                             "prediction": pa.array(total.argmax(axis=1).astype(np.float64))})

        decided = blocks.select("block", "tag").groupBy("block").cogroup(every.groupBy("block")).applyInArrow(decide, f"{id_} long, prediction double")
        found = materialize(decided, "forest-predictions")
        for table in (*votes, blocks):
            discard(table)
        return rows.join(found, id_).drop(id_)


def fit(data: DataFrame, trees: int, depth: int, seed: int) -> StoredForest:
    """A forest on all rows of ``data`` (features vector, label 0, 1, ..., weight, the
    same for all rows of a class)."""
    rows = data.select(vector_to_array("features").alias("x"), "label", "weight")
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"), F.max(F.size("x")).alias("d")).limit(CLASSES + 1).collect()
    if len(found) > CLASSES or any(r.label is None or r.label != int(r.label) or not 0 <= r.label < CLASSES for r in found):
        raise ValueError(f"forest: labels must be whole numbers from 0 to {CLASSES - 1}")
    n, d, k = sum(r.n for r in found), found[0].d, int(max(r.label for r in found)) + 1
    w = np.ones(k)
    for r in found:
        w[int(r.label)] = r.w
    cuts = fit_cuts(rows, d, {r.label: r.w * r.n for r in found})
    blocks = _blocks(rows, "label", "uint8", cuts, "forest-blocks")
    spread = _spread(blocks, n, d)
    model = StoredForest(cuts, k, max(1, min(trees, SHIPPED_ROWS // n)), n)
    stats: dict[tuple[int, int], tuple] = {}
    for first in range(0, trees, model.group):
        uppers = {t: _Upper.root(k) for t in range(first, min(trees, first + model.group))}
        while any((u.kind == OPEN).any() for u in uppers.values()):
            _level(spread, uppers, w, d, seed, depth)
        table = _subtrees(spread, uppers, w, d, seed, depth)
        for r in table.select("tree", "node", "size", "predicted", "importance").collect():
            stats[r.tree, r.node] = (r.size, r.predicted, np.frombuffer(r.importance))
        model.uppers += uppers.values()
        model.tables.append(table)
    discard(blocks)
    model._finish(stats)
    return model
