import pytest

from tidewise.operators.history import decide


@pytest.mark.parametrize("iteration,f1,stop,expected", [
    (2, 0.50, None, False), (0, 0.90, None, False), (0, 0.65, None, True),
    (0, 0.65, True, True), (1, 0.65, True, False), (1, None, None, True),
])
def test_truth_table(spark, iteration, f1, stop, expected):
    df = spark.createDataFrame([("r", iteration, f1, stop)],
                               "run_id string, iteration int, f1 double, should_stop boolean")
    r = decide(df, max_iterations=3).first()
    assert r["should_continue"] is expected and r["next_iteration"] == iteration + 1
