import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.functions import quantiles as Q


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=3000), np.zeros(1500), rng.integers(0, 5, 500).astype(float)])
    g = rng.integers(0, 3, x.size)
    rows = [(float(a), int(b)) for a, b in zip(x, g)]
    rows += [(None, 0)] * 10
    return spark.createDataFrame(rows, "x double, g int"), x, g


@pytest.mark.parametrize("limit", [Q.LIMIT, 40])
def test_exact_against_numpy(data, limit):
    """With a small limit the bracket-narrowing passes are exercised."""
    df, x, g = data
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    series = [(F.col("x"), None)] + [(F.col("x"), F.col("g") == k) for k in range(3)]
    got = Q.quantiles(df, series, [probs] * 4, limit=limit)
    want = [np.quantile(x, probs)] + [np.quantile(x[g == k], probs) for k in range(3)]
    for a, b in zip(got, want):
        assert np.allclose(a, b, rtol=0, atol=1e-12)


def test_order_statistics_bigint(spark):
    """64-bit keys come back from percentile_approx rounded to doubles; the
    widened integral brackets still resolve exactly."""
    vals = [(2 ** 59 + 7 * i,) for i in range(500)]
    df = spark.createDataFrame(vals, "h long")
    got = Q.order_statistics(df, [(F.col("h"), None)], lambda i, n: [0, 99, n - 1], dtype="bigint",
                             limit=25)
    assert got == [[2 ** 59, 2 ** 59 + 7 * 99, 2 ** 59 + 7 * 499]]


def _jobs(monkeypatch):
    """Counts the passes over the data."""
    calls = []
    for name in ("_narrow", "_split", "_resolve"):
        monkeypatch.setattr(Q, name, lambda *a, f=getattr(Q, name), **b: (calls.append(1), f(*a, **b))[1])
    return calls


@pytest.mark.parametrize("dtype, values", [
    ("double", [0.0] * 19_000 + [1.0] * 1_000),
    ("double", [0.0] * 10_000 + [1.0] * 10_000),
    ("double", [-1.5] * 9_000 + [-0.0] * 500 + [0.0] * 500 + [5e-324] * 5_000 + [1e308] * 5_000),
    ("bigint", [7] * 20_000),
    ("bigint", [-(2**62)] * 6_000 + [0] * 8_000 + [2**62] * 6_000),
])
def test_ends_on_repeated_values(spark, monkeypatch, dtype, values):
    """A value that forms most of the rows, far over the limit, takes a few
    passes however often it occurs."""
    calls = _jobs(monkeypatch)
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    ranks = [0, 4_999, 9_999, 10_000, 15_000, 18_999, 19_999]
    got = Q.order_statistics(df, [(F.col("x"), None)], lambda i, n: ranks, dtype=dtype, limit=50)
    assert got == [[sorted(values)[k] for k in ranks]]
    assert len(calls) <= 16


def test_many_targets_share_bounded_jobs(spark, monkeypatch):
    monkeypatch.setattr(Q, "TOTAL", 100)
    df = spark.createDataFrame([(float(i % 977),) for i in range(2000)], "x double")
    probs = [i / 8 for i in range(9)]
    got = Q.quantiles(df, [(F.col("x"), None)], [probs], limit=60)
    assert np.allclose(got[0], np.quantile([i % 977 for i in range(2000)], probs))


def test_empty_series(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.quantiles(df, [(F.col("x"), None)], [[0.5]]) == [[None]]
