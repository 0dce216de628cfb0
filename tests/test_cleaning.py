from pyspark.sql import functions as F

from tidewise.operators.clean import Cleaner, cleaning_report, dropped_rows, parse_timestamps
from tidewise.roles import Roles


def test_no_missing_numerics_or_strings(dirty):
    out = Cleaner().fit(dirty).transform(dirty)
    row = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in
                    Roles().numeric + Roles().categorical]).first()
    assert all(v == 0 for v in row.asDict().values())


def test_strings_stripped_lower(dirty):
    out = Cleaner().fit(dirty).transform(dirty)
    for c in Roles().categorical:
        vals = {r[0] for r in out.select(c).distinct().collect()}
        assert vals <= {"alpha", "beta", "gamma", "delta"}


def test_target_filtered(dirty):
    out = Cleaner().fit(dirty).transform(dirty)
    vals = {r[0] for r in out.select("is_fraud").distinct().collect()}
    assert vals <= {0.0, 1.0}
    assert out.count() < dirty.count()
    assert dropped_rows(dirty).first()["dropped_rows"] == 2


def test_timestamps_typed(dirty):
    out = Cleaner().fit(dirty).transform(dirty)
    types = dict(out.dtypes)
    assert types["timestamp"] == "timestamp_ntz"
    assert types["user_signup_date"] == "timestamp_ntz"


def test_valid_rows_kept(spark):
    df = spark.createDataFrame(
        [("t1", "u1", "2024-01-01 00:00:00", "2023-01-01", "10", "5", "0", "1", "a", "b", "c", "0"),
         ("t2", "u2", "2024-01-02 00:00:00", "2023-01-02", "20", "6", "1", "2", "a", "b", "c", "1"),
         ("t3", "u3", "2024-01-03 00:00:00", "2023-01-03", "30", "7", "0", "3", "a", "b", "c", "0")],
        "transaction_id string, user_id string, timestamp string, user_signup_date string, amount string, "
        "avg_amount_7d string, is_international string, prior_transactions_24h string, "
        "merchant_category string, transaction_type string, device_type string, is_fraud string")
    assert Cleaner().fit(df).transform(df).count() == 3


def test_median_is_exact_and_mode_breaks_ties(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), (None, "b"), ("4", "a"), ("x", None)],
                               "amount string, device_type string")
    roles = Roles(numeric=["amount"], categorical=["device_type"], timestamps=[], target="none")
    m = Cleaner(roles).fit(df)
    assert m.medians["amount"] == 2.0
    assert m.modes["device_type"] == "a"


def test_text_numbers_like_pandas(spark):
    df = spark.createDataFrame([(" 12 ",), ("1e5",), ("+5",), ("5.",), ("1d",), ("inf",), ("NaN",), ("\t7\t",)],
                               "amount string")
    from tidewise.functions.expressions import to_number
    got = [r[0] for r in df.select(to_number(F.col("amount"))).collect()]
    assert got == [12.0, 1e5, 5.0, 5.0, None, None, None, 7.0]


def test_transform_is_one_stage(dirty):
    """No exchange in the cleaning transform: it is a projection + filter."""
    m = Cleaner().fit(dirty)
    plan = m.transform(dirty)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_parse_timestamps_layouts(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01 02:00",), ("2024/01/05",), ("junk",)], "t string")
    out = [r[0] for r in parse_timestamps(df, ["t"], ["yyyy/MM/dd"]).collect()]
    assert out[0].day == 1 and out[1].hour == 2 and out[2].day == 5 and out[3] is None


def test_report_counts(dirty):
    m = Cleaner().fit(dirty)
    rep = {(r["step"], r["column"], r["method"]): r for r in cleaning_report(dirty, m).collect()}
    assert rep[("impute", "amount", "median")]["rows_affected"] == 2
    assert rep[("filter_target", "is_fraud", "keep_0_1")]["rows_affected"] == 2
    assert rep[("shape", None, "rows_after")]["rows_affected"] == 18


def test_read_csv_na_tokens(spark):
    """A header CSV read: pandas' default missing tokens become NULL, other
    text ('none', ' NA') survives, and inference types the columns."""
    import os
    import tempfile
    from tidewise.sources.tables import fit_types, read_table
    d = tempfile.mkdtemp(prefix="tw-csv-", dir="/tmp")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d\n1,x,1.5,N/A\n2,none,,NA\n3, NA,2,null\n")
    df = read_table(spark, path)
    rows = df.orderBy("a").collect()
    assert [r["b"] for r in rows] == ["x", "none", " NA"]
    assert [r["d"] for r in rows] == [None, None, None]
    assert rows[1]["c"] is None
    assert fit_types(df) == {"a": "bigint", "b": "string", "c": "double", "d": "double"}


def test_number_text_with_odd_space(spark):
    from tidewise.functions.expressions import to_number
    texts = ["12", " 12", "12\n", "12 ", " -1.5e2", "1d", "+.5", "", None, "1 2", "\x0012"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_number(F.col("t"))).collect()]
    assert got == [12.0, 12.0, 12.0, 12.0, -150.0, None, 0.5, None, None, None, None]
