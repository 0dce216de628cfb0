from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewise.functions.expressions import micros
from tidewise.operators.windows import trailing, trailing_avg, velocity

SF = "/root/testdata/sf0.001"


def test_prefix_sums_equal_plain_range_windows(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    t = micros(F.col("ts"))
    day = 86_400_000_000
    w1 = Window.partitionBy("user_id").orderBy(t).rangeBetween(-day, 0)
    w7 = Window.partitionBy("user_id").orderBy(t).rangeBetween(-7 * day, 0)
    want = ev.select("event_id", (F.count(F.lit(1)).over(w1) - 1).alias("n"), F.avg("value").over(w7).alias("a"))
    got = trailing_avg(velocity(ev)).select("event_id", F.col("prior_transactions_24h").alias("n"),
                                            F.col("avg_amount_7d").alias("a"))
    diff = (got.join(want, "event_id", "full")
            .filter((got.n != want.n) | (F.abs(got.a - want.a) > 1e-9) | got.n.isNull() | want.n.isNull()))
    assert diff.count() == 0 and got.count() == ev.count()


def test_ties_count_as_peers(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"),
                                (1, "2024-01-02 00:00:00"), (1, "2024-01-03 00:00:01")], "user_id int, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(r[0] for r in velocity(df).select("prior_transactions_24h").collect())
    assert got == [0, 1, 1, 2]


def test_rows_without_time_are_peers(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0), (1, "2024-01-01 00:00:00", 6.0), (2, None, 1.0), (None, "2024-01-01 00:00:00", 3.0)],
                               "user_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(map(tuple, trailing_avg(velocity(df)).select("value", "prior_transactions_24h", "avg_amount_7d").collect()))
    assert got == [(1.0, 0, 1.0), (2.0, 1, 3.0), (3.0, 0, 3.0), (4.0, 1, 3.0), (6.0, 0, 6.0)]


def test_missing_values_and_slices(spark):
    """Slices far narrower than the frame; NULL values do not count in a mean."""
    rows = [(1, f"2024-01-0{d} {h:02d}:30:00", None if h % 5 == 0 else float(d * h)) for d in range(1, 6) for h in range(0, 24, 3)]
    df = spark.createDataFrame(rows, "user_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    t = micros(F.col("ts"))
    w = Window.partitionBy("user_id").orderBy(t).rangeBetween(-86_400_000_000, 0)
    want = df.select("ts", (F.count(F.lit(1)).over(w) - 1).alias("n"), F.avg("value").over(w).alias("a")).orderBy("ts").collect()
    for slice_us in (600_000_000, 3_600_000_000, 10**15):
        got = trailing(df, "user_id", "ts", {"n": (1, None), "a": (1, "value")}, slice_us).select("ts", "n", "a").orderBy("ts").collect()
        assert [(r.ts, r.n) for r in got] == [(r.ts, r.n) for r in want]
        assert all((x.a is None) == (y.a is None) and (x.a is None or abs(x.a - y.a) < 1e-9) for x, y in zip(got, want))


def _against_plain(spark, values, width=2):
    """Frames of ``width`` days over one row a day, compared with a plain window."""
    rows = [(1 + i % 2, f"2024-01-{1 + i // 2:02d} 00:00:00", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "user_id int, ts string, value double, i int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    w = Window.partitionBy("user_id").orderBy(micros(F.col("ts"))).rangeBetween(-width * 86_400_000_000, 0)
    want = [r[0] for r in df.select("i", F.avg("value").over(w).alias("a")).orderBy("i").select("a").collect()]
    got = [r[0] for r in trailing_avg(df, days=width).orderBy("i").select("avg_amount_7d").collect()]
    assert len(got) == len(want)
    for g, a in zip(got, want):
        assert (g is None) == (a is None)
        assert g is None or g == a or (g != g and a != a) or abs(g - a) <= 1e-12 * max(abs(g), abs(a)), (g, a)


def test_non_finite_values_as_in_a_plain_window(spark):
    inf, nan = float("inf"), float("nan")
    _against_plain(spark, [1.0, 2.0, inf, 3.0, 4.0, -inf, None, 5.0, nan, 6.0, 7.0, 8.0, inf, -inf, -inf, inf, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
    _against_plain(spark, [nan, inf, None, -inf] * 3)
    _against_plain(spark, [None] * 6)


def test_huge_and_tiny_values(spark):
    _against_plain(spark, [1e20, 3e19, 1.5e20, 2.0, 3.0, 1e16, 4.25, 7e18])
    _against_plain(spark, [1e300, 2e299, 1e298, 1.5e300] * 3)
    _against_plain(spark, [1e-13, 3e-14, 2e-13, 5e-13] * 3)
    _against_plain(spark, [1e-290, 3e-291, 2e-290, 5e-290] * 3)
    _against_plain(spark, [0.1, 0.2, 0.3, -0.6] * 4)


def test_frames_need_no_join(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 2.0), (None, "2024-01-09 00:00:00", 4.0), (1, "2024-01-07 12:00:00", 6.0)],
                               "user_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = trailing(df, "user_id", "ts", {"n": (1, None), "a": (7, "value")})
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.value, r.n, r.a) for r in out.collect()) == [(2.0, 0, 2.0), (4.0, 0, 4.0), (6.0, 0, 4.0)]
