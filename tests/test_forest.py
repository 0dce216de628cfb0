import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.operators import forest, modeling as M


@pytest.fixture(scope="module")
def cells(spark):
    """400 cells of two columns with a label each: a part of the rows does not tell them."""
    rng = np.random.default_rng(3)
    n = 6000
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 20, n), rng.normal(size=n)
    y = rng.integers(0, 2, (20, 20))[a, b]
    rows = [(f"k{i}", float(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, a double, b double, c double, y double").repartition(4).cache()


CONFIG = {"model_name": "RandomForestClassifier", "hyperparameters": {"n_estimators": 6}}


def hits(t):
    return t.test_predictions().filter("label = prediction").count() / t.n_test


def small(monkeypatch, rows=400):
    monkeypatch.setattr(M, "FOREST_DRIVER_ROWS", rows, raising=False)
    monkeypatch.setattr(M, "FOREST_FIT_ROWS", rows, raising=False)  # the former bound of the fitted rows
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 700)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 500)
    monkeypatch.setattr(forest, "CHUNK", 2)
    monkeypatch.setattr(forest, "SHIPPED_ROWS", 3 * 4800)


def test_forest_learns_from_every_row(cells, monkeypatch):
    """train_random_forest, feature_importance, improve_loop: no sample of the rows."""
    whole = M.train(cells, "y", "key", CONFIG)
    small(monkeypatch)
    stored = M.train(cells, "y", "key", CONFIG)
    assert stored.model.rows == stored.n_train
    assert len(stored.model.tables) == 2 and len(stored.model.uppers) == 6
    assert hits(stored) > 0.9 and abs(hits(stored) - hits(whole)) < 0.05
    top = {r.feature: r.importance for r in stored.importance().collect()}
    want = {r.feature: r.importance for r in whole.importance().collect()}
    assert sum(top.values()) == pytest.approx(1.0) and all(abs(top[f] - want[f]) < 0.1 for f in want)


def test_votes_equal_walks_of_all_trees(cells, monkeypatch):
    small(monkeypatch)
    t = M.train(cells, "y", "key", CONFIG)
    model = t.model
    rows = t.model.transform(t.prepare(t.split.filter("split = 'test'"))).select("features", "prediction").collect()
    x = np.stack([r.features.toArray() for r in rows])
    codes = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(model.cuts)]).astype(np.uint8)
    subs = {(r.tree, r.node): r for table in model.tables for r in table.collect()}
    votes, nodes = np.zeros((len(x), 2)), 0
    for i, u in enumerate(model.uppers):
        at = forest.walk(codes, u.nodes.feature, u.nodes.cut, u.nodes.left)
        for node in np.unique(at):
            own = at == node
            if u.kind[node] == forest.STORED:
                s = subs[i, node]
                end = forest.walk(codes[own], np.frombuffer(s.feature, np.int16), np.frombuffer(s.cut, np.uint8), np.frombuffer(s.left, np.int32))
                votes[own] += np.frombuffer(s.held, np.float32).reshape(-1, 2)[end]
            else:
                held = u.nodes.held[node]
                votes[own] += held / held.sum()
    assert votes.sum(axis=1) == pytest.approx(np.full(len(x), 6.0), abs=1e-4)
    assert [r.prediction for r in rows] == list(votes.argmax(axis=1))


def test_upper_nodes_count_every_draw(cells, monkeypatch):
    """A tree's root holds all draws of all rows, by class."""
    small(monkeypatch)
    data = M.assemble(cells.withColumn("weight", F.lit(1.0)).withColumnRenamed("y", "label"), ["a", "b", "c"])
    held = []
    split = forest._Upper.split

    def seen(self, found, w, depth):
        held.extend(found[:1, 3:5].sum(axis=1) if self.kind[0] == forest.OPEN else [])
        split(self, found, w, depth)

    monkeypatch.setattr(forest._Upper, "split", seen)
    model = forest.fit(data.select("features", "label", "weight"), 3, 30, 42)
    assert len(held) == 3 and all(abs(h - 6000) < 5 * np.sqrt(6000) for h in held)
    assert model.totalNumNodes > 3 * 100


@pytest.mark.parametrize("classes", [2, 3])
def test_both_searches_find_the_best_cut(classes):
    rng = np.random.default_rng(classes)
    nodes, m = 7, 900
    node, code, y = rng.integers(0, nodes, m), rng.integers(0, forest.BINS, m), rng.integers(0, classes, m)
    n, w = rng.integers(1, 4, m), rng.uniform(0.5, 2, classes)
    counts = np.bincount(node * classes + y, weights=n, minlength=nodes * classes).astype(np.int64).reshape(nodes, classes)
    dense = forest._best_dense((node * forest.BINS + code) * classes + y, n, counts, w)
    runs = forest._best_sorted(node, code, y, n, counts, w)
    assert dense[0] == pytest.approx(runs[0])
    for i in range(nodes):
        own = node == i

        def impurity(rows):
            h = np.bincount(y[rows], weights=n[rows] * w[y[rows]], minlength=classes)
            return h.sum() - (h * h).sum() / h.sum() if h.sum() else 0.0

        gains = [impurity(own) - impurity(own & (code <= c)) - impurity(own & (code > c)) for c in range(forest.BINS - 1)]
        assert dense[0][i] == pytest.approx(max(gains))
        assert gains[int(dense[1][i])] == pytest.approx(max(gains)) == pytest.approx(gains[int(runs[1][i])])


def test_cuts_of_few_and_many_values(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 3, 3000).astype(float), rng.normal(size=3000), np.zeros(3000)]
    rows = spark.createDataFrame([([float(v) for v in r], float(i % 2)) for i, r in enumerate(x)], "x array<double>, label double").repartition(3)
    few, many, none = forest.fit_cuts(rows, 3, {0.0: 1.0, 1.0: 1.0})
    assert list(few) == [0.5, 1.5] and not len(none)
    share = np.searchsorted(np.sort(x[:, 1]), many, side="right") / 3000
    assert np.abs(share - np.arange(1, forest.BINS) / forest.BINS).max() < 0.01


def test_labels_that_are_no_classes(spark):
    data = M.assemble(spark.createDataFrame([(1.0, 0.5, 1.0)], "a double, label double, weight double"), ["a"])
    with pytest.raises(ValueError, match="whole numbers"):
        forest.fit(data, 2, 5, 1)
