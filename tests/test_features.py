import pytest

from tidewise.operators.features import (
    DEFAULT_FEATURES, REGISTRY, FeatureSet, OneHot, build_features, drop_roles,
)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_each_feature_creates_column(feature_frame, name):
    m = FeatureSet([name]).fit(feature_frame)
    out = m.transform(feature_frame)
    assert name in out.columns and m.created == [name]


@pytest.mark.parametrize("name", list(REGISTRY))
def test_missing_sources_skip(spark, name):
    df = spark.createDataFrame([(1,)], "unrelated int")
    m = FeatureSet([name]).fit(df)
    assert m.created == [] and m.skipped[0][0] == name
    assert m.transform(df).columns == ["unrelated"]


def test_dependencies_created(feature_frame):
    m = FeatureSet(["is_new_account", "is_night_txn", "is_weekend"]).fit(feature_frame)
    cols = m.transform(feature_frame).columns
    for c in ["account_age_days", "hour_of_day", "day_of_week"]:
        assert c in cols
    assert m.plan[0] == ["account_age_days", "hour_of_day", "day_of_week"]


def test_unknown_skipped(feature_frame):
    m = FeatureSet(["log_amount", "nope"]).fit(feature_frame)
    assert m.created == ["log_amount"] and m.skipped == [("nope", "unknown feature")]


def test_defaults_when_empty(feature_frame):
    m = FeatureSet([]).fit(feature_frame)
    assert m.created == DEFAULT_FEATURES and m.source == "default"


def test_values(feature_frame):
    m = FeatureSet(list(REGISTRY)).fit(feature_frame)
    rows = m.transform(feature_frame).collect()
    r0, r2 = rows[0], rows[2]
    assert r0["account_age_days"] == 17 and r0["hour_of_day"] == 2 and r0["day_of_week"] == 0
    assert r2["amount_to_avg_ratio"] == 1.0 and r2["txn_per_avg_ratio"] == 0.0
    assert r2["is_night_txn"] == 1 and r2["is_weekend"] == 1
    assert rows[3]["is_high_amount"] == 1 and sum(r["is_high_amount"] for r in rows) == 1
    assert rows[1]["high_velocity"] == 1 and rows[0]["high_velocity"] == 0


def test_one_hot_drops_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "device_type string")
    m = OneHot(["device_type"]).fit(df)
    assert m.columns == ["device_type_b", "device_type_c"]
    rows = m.transform(df).collect()
    assert [(r["device_type_b"], r["device_type_c"]) for r in rows] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_build_features_drops_ids(dirty):
    from tidewise.operators.clean import Cleaner
    clean = Cleaner().fit(dirty).transform(dirty)
    cols = build_features(clean).columns
    assert "transaction_id" not in cols and "merchant_category" not in cols
    assert "is_fraud" in cols and "account_age_days" in cols
    assert drop_roles(clean).columns == ["amount", "avg_amount_7d", "is_international",
                                         "prior_transactions_24h", "is_fraud"]


def test_clean_table_is_written_once_for_the_fits(spark):
    from tidewise.plans import views
    plan = views.features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan
