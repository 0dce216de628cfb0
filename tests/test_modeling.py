import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.operators import modeling as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = ((x1 + 0.5 * x2 + rng.normal(scale=0.5, size=n)) > 1.0).astype(float)
    rows = [(f"k{i}", float(x1[i]), float(x2[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, x1 double, x2 double, y double")


def test_split_exact_disjoint_repeatable(table):
    s1 = M.stratified_split(table, "y", "key").collect()
    s2 = M.stratified_split(table.repartition(7), "y", "key").collect()
    assert {(r["key"], r["split"]) for r in s1} == {(r["key"], r["split"]) for r in s2}
    for cls in (0.0, 1.0):
        n = sum(1 for r in s1 if r["y"] == cls)
        t = sum(1 for r in s1 if r["y"] == cls and r["split"] == "test")
        assert t == int(np.ceil(0.2 * n))
    assert len(s1) == table.count()


def test_scaler_train_moments(table):
    sp = M.stratified_split(table, "y", "key")
    tr = sp.filter("split = 'train'")
    out = M.Scaler(["x1", "x2"]).fit(tr).transform(tr)
    row = out.agg(F.avg("x1"), F.stddev_pop("x1")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9


def test_balanced_weights_sum_to_n(table):
    w = M.balanced_weights(table, "y").agg(F.sum("weight"), F.count("*")).first()
    assert abs(w[0] - w[1]) < 1e-9


def test_logistic_optimum_matches_sklearn_objective(table):
    t = M.train(table, "y", "key", {"model_name": "LogisticRegression", "hyperparameters": {"C": 1.0}})
    data = t.prepare(M.balanced_weights(t.split.filter("split = 'train'"), "y")).toPandas()
    X = np.stack(data["features"].map(lambda v: v.toArray()))
    y, w = data["label"].to_numpy(), data["weight"].to_numpy()
    b, c0 = t.model.coefficients.toArray(), t.model.intercept
    p = 1 / (1 + np.exp(-(X @ b + c0)))
    grad_b = 1.0 * (X.T @ (w * (p - y))) + b   # d/db of C*sum(w*loss) + |b|^2/2
    grad_c = np.sum(w * (p - y))
    assert np.max(np.abs(grad_b)) < 1e-3 and abs(grad_c) < 1e-3


@pytest.mark.parametrize("config", [
    {"model_name": "RandomForestClassifier", "hyperparameters": {"n_estimators": 20, "max_depth": 5}},
    {"model_name": "GradientBoostingClassifier", "hyperparameters": {"n_estimators": 10}},
    {"model_name": "SVC", "hyperparameters": {"C": 1.0, "kernel": "linear"}},
    {"model_name": "SVC", "hyperparameters": {"C": 1.0}},
    {"model_name": "Unknown", "hyperparameters": {}},
])
def test_trainers_predict(table, config):
    t = M.train(table, "y", "key", config)
    preds = t.test_predictions()
    assert preds.count() == t.n_test and set(r[0] for r in preds.select("prediction").distinct().collect()) <= {0.0, 1.0}


def test_importance_sums_to_one_for_trees(table):
    t = M.train(table, "y", "key", {"model_name": "RandomForestClassifier",
                                    "hyperparameters": {"n_estimators": 10, "max_depth": 4}})
    imp = t.importance().collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    assert imp[0]["feature"] == "x1"


def test_rbf_beats_linear_on_ring(spark):
    rng = np.random.default_rng(1)
    n = 600
    r = np.concatenate([rng.uniform(0, 1, n // 2), rng.uniform(2, 3, n // 2)])
    a = rng.uniform(0, 2 * np.pi, n)
    y = np.concatenate([np.zeros(n // 2), np.ones(n // 2)])
    rows = [(f"k{i}", float(r[i] * np.cos(a[i])), float(r[i] * np.sin(a[i])), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, x1 double, x2 double, y double")
    from tidewise.operators.evaluate import evaluate
    acc = {}
    for kern in ("rbf", "linear"):
        t = M.train(df, "y", "key", {"model_name": "SVC", "hyperparameters": {"C": 1.0, "kernel": kern}})
        acc[kern] = evaluate(t.test_predictions()).first()["accuracy"]
    assert acc["rbf"] > 0.9 and acc["rbf"] > acc["linear"]


def test_split_is_exact_for_repeated_keys(spark):
    from tidewise.operators import modeling as M
    df = spark.range(1000).selectExpr("cast(id % 2 as double) as y", "concat('k', cast(id % 4 as string)) as k", "id as x")
    n = {(r.y, r.split): r["count"] for r in M.stratified_split(df, "y", "k").groupBy("y", "split").count().collect()}
    assert n == {(0.0, "test"): 100, (0.0, "train"): 400, (1.0, "test"): 100, (1.0, "train"): 400}


def test_many_classes(spark, monkeypatch):
    from tidewise.operators import modeling as M
    monkeypatch.setattr(M, "CLASSES_AT_ONCE", 3)
    df = spark.range(400).selectExpr("cast(id % 8 as double) as y", "id as k")
    n = {r.y: r["count"] for r in M.stratified_split(df, "y", "k").filter("split = 'test'").groupBy("y").count().collect()}
    assert n == {float(i): 10 for i in range(8)}


def test_key_is_not_the_target(spark):
    from tidewise.roles import Roles
    df = spark.createDataFrame([(1, 2.0)], "y int, x double")
    with pytest.raises(ValueError):
        Roles.infer(df, "y", "y")
    assert Roles.infer(df, "y").key == "x"


def test_split_quota_counts_rows_without_key(spark):
    rows = [(None, 0, i) for i in range(90)] + [(f"k{i}", 1, i) for i in range(100)] + [(None, 1, 1000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, y int, v int")
    split = M.stratified_split(df, "y", "k").cache()
    assert {r.y: r["count"] for r in split.filter("split = 'test'").groupBy("y").count().collect()} == {0: 18, 1: 22}
    again = M.stratified_split(df.repartition(5), "y", "k")
    assert split.exceptAll(again).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_class_meets_in_one_task(table):
    """Few classes are joined without a shuffle of the rows by class."""
    split = M.stratified_split(table, "y", "key")
    weighted = M.balanced_weights(split, "y")
    for plan in (_plan(split), _plan(weighted)):
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "md5" not in _plan(split)  # the hashes were written once


def test_weights_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASSES_AT_ONCE", 3)
    df = spark.range(90).selectExpr("case when id < 10 then null when id < 50 then 0.0 else cast(id % 4 + 1 as double) end as y", "id as k")
    weighted = M.balanced_weights(df, "y")
    got = {(r.y, r.weight): r["count"] for r in weighted.groupBy("y", "weight").count().collect()}
    assert got == {(None, None): 10, (0.0, 90 / (6 * 40)): 40} | {(float(i), 90 / (6 * 10)): 10 for i in range(1, 5)}
    assert "_salt" in _plan(weighted)


def test_fitted_rows_are_spread(spark, table):
    cores = spark.sparkContext.defaultParallelism
    assert M.fit_partitions(spark, 400) == 1
    assert M.fit_partitions(spark, 100_000) == min(2 * cores, 100)
    assert M.fit_partitions(spark, 40_000_000) == max(2 * cores, 400)


def test_forest_in_groups_votes_as_one(spark, table):
    """Many partitions: trees are fitted in groups of few partitions, none is
    lost, and a class is that of most votes of all trees."""
    est = M.make_estimator("RandomForestClassifier", {"n_estimators": 11, "max_depth": 4}, 1.0)
    data = M.assemble(table.withColumnsRenamed({"y": "label"}).withColumn("weight", F.lit(1.0)), ["x1", "x2"])
    data = data.repartition(M.FOREST_PARTS + 3).persist()
    forest = M.fit_forest(est, data, M.FOREST_PARTS + 3)
    assert isinstance(forest, M.Forest) and len(forest.groups) > 1
    trees = [t for m in forest.groups for t in m.trees]
    assert len(trees) == 11
    assert abs(forest.featureImportances.toArray().sum() - 1.0) < 1e-9
    rows = forest.transform(data).select("features", "prediction").limit(50).collect()
    for r in rows:
        votes = sum(raw / raw.sum() for raw in (t.predictRaw(r.features).toArray() for t in trees))
        assert r.prediction == float(np.argmax(votes))
    assert not isinstance(M.fit_forest(est, data.coalesce(1), 1), M.Forest)


def test_fourier_features_pass_as_flat_buffers(table):
    """The map equals the formula, and its plan builds no array per row before
    the Python step."""
    train = table.fillna(0.0)
    rff = M.fit_rff(train, ["x1", "x2"], components=7)
    out = rff.transform(train)
    assert "array(" not in _plan(out).split("ArrowEvalPython")[-1]
    rows = out.select("x1", "x2", "rff").collect()
    x = np.array([[r.x1, r.x2] for r in rows])
    want = np.sqrt(2 / 7) * np.cos(x @ rff.omega.T + rff.phase)
    assert np.allclose(np.stack([r.rff.toArray() for r in rows]), want, atol=1e-12)
    assert rff.transform(train.limit(0)).count() == 0


def test_exact_svc_caches_no_fitted_rows(table, monkeypatch):
    """The partitions of the fitted rows grow with the table: none may be cached whole."""
    held = []
    solve = M.kernel_svc.fit

    def fit(data, *args):
        held.append(data.storageLevel)
        return solve(data, *args)

    monkeypatch.setattr(M.kernel_svc, "fit", fit)
    M.train(table, "y", "key", {"model_name": "SVC", "hyperparameters": {"C": 1.0, "exact": True}})
    assert not held[0].useMemory and not held[0].useDisk
