"""Plan-shape guards for the scale design (see PLANS.md)."""

from tidewise.operators import history as H
from tidewise.operators import profile as P
from tidewise.plans import views as V
from tidewise.sources import fixtures

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_window_shuffles_on_entity_and_slice(spark):
    plan = _plan(fixtures.raw(spark, SF))
    assert "hashpartitioning(user_id" in plan and "_slice" in plan.split("hashpartitioning(user_id")[1][:40]
    assert "props" not in plan.split("FileScan")[1].split("]")[0]  # column pruned at the scan


def test_top_k_per_group_is_partial_before_shuffle(spark):
    plan = _plan(H.best_round(V.history(spark, SF)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_history_is_a_projection_of_all_events(spark):
    assert "Exchange" not in _plan(V.history(spark, SF))
    assert V.history(spark, SF).count() == fixtures.events(spark, SF).count()


def test_fitted_feature_table_has_no_exchange(spark):
    plan = _plan(V.features(spark, SF))
    assert "Exchange" not in plan


def test_correlations_one_aggregate(spark):
    plan = _plan(P.correlations(V.typed(spark, SF)))
    assert plan.count("hashpartitioning") == 0  # one global partial + final aggregate
