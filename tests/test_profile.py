from tidewise.operators import profile as P


def _quality(spark, **over):
    rows = [(1.0, 2.0, 1, "x", 0.0), (2.0, None, 2, "y", 1.0), (3.0, 4.0, 3, None, 0.0),
            (4.0, 5.0, 4, "z", 1.0), (5.0, 6.0, 5, "w", 0.0)]
    if over.get("no_missing"):
        rows = [(1.0, 2.0, 1, "x", 0.0), (2.0, 3.0, 2, "y", 1.0)]
    if over.get("duplicate"):
        rows = rows + [rows[0]]
    if over.get("bad_target"):
        rows = rows + [(6.0, 7.0, 6, "v", 2.0)]
    return spark.createDataFrame(rows, "col_a double, col_b double, col_c long, cat_col string, label double")


def test_missing_reported(spark):
    m = {r["column"]: r["missing"] for r in P.missing(_quality(spark)).collect()}
    assert m == {"col_b": 1, "cat_col": 1}


def test_no_missing(spark):
    assert P.missing(_quality(spark, no_missing=True)).count() == 0


def test_duplicates(spark):
    for method in ("hash", "direct"):
        assert P.duplicate_count(_quality(spark, duplicate=True), method).first()[0] == 1
        assert P.duplicate_count(_quality(spark), method).first()[0] == 0


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("a", None), (None, None), (None, None), ("", None)],
                               "x string, y string")
    assert P.duplicate_count(df).first()[0] == 2


def test_unexpected_target(spark):
    tq = P.target_quality(_quality(spark, bad_target=True), "label").first()
    assert tq["unexpected_values"] == "2.0" and tq["n_unexpected"] == 1


def test_describe_matches_pandas(spark):
    df = _quality(spark)
    pdf = df.toPandas()
    got = {r["column"]: r for r in P.describe(df).collect()}
    for c in ["col_a", "col_b", "col_c", "label"]:
        d = pdf[c].describe()
        assert got[c]["count"] == d["count"]
        assert abs(got[c]["q25"] - d["25%"]) < 1e-9
        assert abs(got[c]["q50"] - d["50%"]) < 1e-9
        assert abs(got[c]["std"] - round(d["std"], 6)) < 1e-9


def test_correlation_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "a double, b double, k double")
    r = {(x["a"], x["b"]): x["r"] for x in P.correlations(df).collect()}
    pdf = df.toPandas()
    assert abs(r[("a", "b")] - round(pdf["a"].corr(pdf["b"]), 6)) < 1e-9
    assert r[("a", "k")] is None


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)], "x double")
    h = P.histograms(df, ["x"], bins=30).orderBy("bin").collect()
    assert len(h) == 30 and sum(r["n"] for r in h) == 31 and h[-1]["n"] == 2


def test_outliers_three_sigma(spark):
    vals = [(float(i % 5),) for i in range(100)] + [(1000.0,)]
    df = spark.createDataFrame(vals, "x double")
    assert P.outliers(df, ["x"]).first()["n_outliers"] == 1


def test_box_stats(spark):
    import numpy as np
    rows = [(float(v), float(g)) for g in (0, 1) for v in list(range(20)) + [100]]
    df = spark.createDataFrame(rows, "x double, g double")
    b = {r["g"]: r for r in P.box_stats(df, ["x"], by="g").collect()}
    arr = np.array(list(range(20)) + [100], dtype=float)
    q1, q3 = np.percentile(arr, [25, 75])
    assert b[0.0]["q1"] == round(q1, 6) and b[0.0]["n_fliers"] == 1
    assert b[0.0]["whisker_hi"] == 19.0


def test_nothing_is_cut(spark, monkeypatch):
    """Ten numeric columns, 300 target values and more groups than one step
    takes give full results."""
    from tidewise.operators import profile as P
    monkeypatch.setattr(P, "GROUPS_AT_ONCE", 4)
    df = spark.range(600).selectExpr(*[f"(id * {7 + i}) % 101 as c{i}" for i in range(10)], "id % 9 as g", "cast(id % 300 as double) as y")
    q = P.target_quality(df, "y").first()
    assert q["n_unexpected"] == 298 and len(q["unexpected_values"].split(",")) == 298 and len(q["distinct_values"].split(",")) == 300
    assert P.histograms(df.drop("g", "y"), bins=3).select("column").distinct().count() == 10
    box = P.box_stats(df.select("c0", "c1", "c2", "c3", "c4", "g"), by="g")
    assert box.count() == 45


def test_summaries_do_not_copy_rows_per_column(spark):
    from tidewise.operators import profile as P
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 2.0), (None, 2.0)], "s string, x double")
    summary = P.column_summary(df)
    assert "Expand" not in summary._jdf.queryExecution().executedPlan().toString()
    assert [(r.column, r.non_null, r.n_unique) for r in summary.orderBy("position").collect()] == [("s", 3, 2), ("x", 3, 2)]
    row = P.describe(df, include="all").filter("column = 's'").first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (3, 2, "a", 2)


def test_text_target_is_not_missing(spark):
    from tidewise.operators import profile as P
    df = spark.createDataFrame([("1",), ("0",), ("x",), (None,)] * 5, "y string")
    found = {r["kind"]: r["n"] for r in P.issues(df, "y").collect()}
    assert found["target_missing"] == 5


def test_box_groups_are_not_shuffled(spark):
    df = spark.range(200).selectExpr("cast(id % 2 as double) as g", "cast(id as double) as x")
    out = P.box_stats(df, ["x"], by="g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert sorted((r.g, r.q1, r.median, r.q3, r.n_fliers) for r in out.collect()) == [(0.0, 49.5, 99.0, 148.5, 0), (1.0, 50.5, 100.0, 149.5, 0)]
