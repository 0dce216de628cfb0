import numpy as np
from pyspark.sql import functions as F

from tidewise.functions.grouped import group_order_statistics, group_quantiles
from tidewise.operators import modeling as M
from tidewise.operators import profile as P


def test_quantiles_of_many_groups_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 400, 6000), rng.normal(0, 1e3, 6000).round(1))]
    rows += [(7, 5.0)] * 4000 + [(8, None), (401, 1e300), (401, -1e300), (402, float("inf"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(9)
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            assert got[g][name] == vs[0] if len(vs) == 1 else np.isclose(got[g][name], np.quantile(vs, q), rtol=1e-12)


def test_one_group_over_many_ranges(spark):
    df = spark.range(50_000).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    vs = sorted(r.v for r in df.collect())
    got = {r.tag: r.value for r in group_order_statistics(df, ["g"], "v", lambda n: {"first": F.lit(0), "some": F.floor(n / 3), "last": n - 1, "none": n}).collect()}
    assert got == {"first": vs[0], "some": vs[50_000 // 3], "last": vs[-1]}


def test_box_stats_of_many_groups_equal_the_bracket_search(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(float(g), float(a), None if a < -1 else float(b)) for g, a, b in zip(rng.integers(0, 20, 900), rng.normal(0, 1, 900), rng.integers(0, 50, 900))]
    df = spark.createDataFrame(rows, "g double, a double, b double")
    few = sorted(map(tuple, P.box_stats(df, ["a", "b"], "g").collect()))
    monkeypatch.setattr(P, "GROUPS_AT_ONCE", 3)
    assert sorted(map(tuple, P.box_stats(df, ["a", "b"], "g").collect())) == few and len(few) == 40


def test_split_of_many_classes_equals_the_bracket_search(spark, monkeypatch):
    rows = [(f"k{i % 150}" if i % 7 else None, i % 11, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, y int, v int")
    few = sorted(map(tuple, M.stratified_split(df, "y", "k").select("v", "split").collect()))
    monkeypatch.setattr(M, "CLASSES_AT_ONCE", 4)
    assert sorted(map(tuple, M.stratified_split(df, "y", "k").select("v", "split").collect())) == few
    n = {y: sum(1 for _, c, _ in rows if c == y) for y in range(11)}
    test = {v for v, s in few if s == "test"}
    assert {y: sum(1 for _, c, v in rows if c == y and v in test) for y in n} == {y: -(-c // 5) for y, c in n.items()}


def test_no_driver_list_for_a_thousand_classes(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 1000).alias("y"))
    counts = M.stratified_split(df, "y", "k").groupBy("y", "split").count().groupBy("split", "count").count().collect()
    assert {(r[0], r[1], r[2]) for r in counts} == {("test", 1, 1000), ("train", 4, 1000)}
