import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewise.operators import modeling as M
from tidewise.operators.features import OneHot, OneHotModel, WideOneHotModel, wide_one_hot_fit
from tidewise.session import discard, materialize, shared


def test_few_and_wide_agree(spark):
    rows = [(i, [None, "b", "a", "c", "d"][i % 5], ["x", "y"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, u string, w string")
    few, wide = OneHot(["u", "w"]).fit(df), OneHot(["u", "w"], max_categories=5).fit(df)
    assert isinstance(few, OneHotModel) and isinstance(wide, WideOneHotModel)
    assert wide.sizes == {"u": 3, "w": 1}
    flat = {r["id"]: [r[c] for c in few.columns] for r in few.transform(df).collect()}
    sparse = {r["id"]: r["x"] for r in wide.transform(df).select("id", vector_to_array("onehot").alias("x")).collect()}
    assert {k: [float(x) for x in v] for k, v in flat.items()} == sparse


def test_hot_missing_unseen_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 30 + [("b", 2), ("c", 3), (None, 4), (None, 4)], "v string, n int")
    model = wide_one_hot_fit(df, ["v"])
    more = df.unionAll(spark.createDataFrame([("zz", 9)], "v string, n int"))
    out = [(r["v"], r["x"]) for r in model.transform(more).select("v", vector_to_array("onehot").alias("x")).collect()]
    want = {"a": [0.0, 0.0], "b": [1.0, 0.0], "c": [0.0, 1.0], None: [0.0, 0.0], "zz": [0.0, 0.0]}
    assert len(out) == 35 and all(x == want[v] for v, x in out)


def test_no_category_at_all(spark):
    df = spark.createDataFrame([(None, "q")], "v string, w string")
    model = wide_one_hot_fit(df, ["v", "w"])
    assert model.sizes == {"v": 0, "w": 0}
    assert model.transform(df).count() == 1


def test_many_categories_without_a_list_on_the_driver(spark):
    df = spark.range(200_000).select(F.format_string("c%07d", "id").alias("v"), "id")
    model = OneHot(["v"]).fit(df)
    assert model.sizes == {"v": 199_999}
    places = model.indexed(df).filter("id > 0").agg(F.count_if(F.col("_i0") == F.col("id") - 1).alias("n")).first()
    assert places["n"] == 199_999


def test_wide_columns_train(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", float(rng.normal()), f"c{i % 40}", float((i % 40) < 20)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, x double, c string, y double")
    table = OneHot(["c"], max_categories=10).fit(df).transform(df).drop("c")
    t = M.train(table, "y", "k", {"model_name": "LogisticRegression", "hyperparameters": {"C": 100.0}})
    wrong = t.test_predictions().filter("label <> prediction").count()
    assert wrong == 0 and t.importance(3).count() == 3 and t.converged
    with pytest.raises(ValueError, match="RBF"):
        M.train(table, "y", "k", {"model_name": "SVC", "hyperparameters": {}})


def test_logistic_gradient_is_zero_only_at_the_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + rng.normal(size=500) > 0.4).astype(float)
    df = spark.createDataFrame([(f"k{i}", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "k string, a double, b double, y double")
    t = M.train(df, "y", "k", {"model_name": "LogisticRegression", "hyperparameters": {"C": 1.0}})
    found = {r["term"]: r["gradient"] for r in M.logistic_gradient(t).collect()}
    assert set(found) == {"a", "b", "(intercept)"} and max(map(abs, found.values())) < 1e-5
    t.hyperparameters = {"C": 0.001}  # another objective: no longer its optimum
    assert max(abs(r["gradient"]) for r in M.logistic_gradient(t).collect()) > 1e-3


def test_shared_table_follows_its_source(spark, tmp_path):
    source, built = str(tmp_path / "s.parquet"), []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    spark.range(5).write.parquet(source)
    first = [shared(spark, "t", source, build).count() for _ in range(2)]
    spark.range(9).write.mode("append").parquet(source)
    assert first == [5, 5] and shared(spark, "t", source, build).count() == 14 and len(built) == 2


def test_discard_removes_only_stored_tables(spark):
    df = materialize(spark.range(3).toDF("n"), "gone")
    path = df.stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    discard(df)
    discard(spark.range(1))
    assert not os.path.isdir(path)
