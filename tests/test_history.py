from tidewise.operators import history as H


def test_features_used(history_frame):
    rows = H.features_available(history_frame).orderBy("iteration").collect()
    assert rows[0]["features_used"] == ["account_age_days", "hour_of_day", "day_of_week",
                                        "amount_to_avg_ratio", "is_high_amount"]
    assert "log_amount" in rows[0]["features_unused"] and "log_amount" not in rows[1]["features_unused"]


def test_model_config(history_frame):
    rows = H.model_config(history_frame).orderBy("iteration").collect()
    assert rows[0]["config_model"] == "LogisticRegression" and rows[0]["config_params"] == {"C": "1.0"}
    assert rows[1]["config_params"] == {"n_estimators": "200"}


def test_diagnose(history_frame):
    d = {(r["code"], r["iteration"]): r for r in H.diagnose(history_frame).collect()}
    assert ("f1_gain", 1) in d and abs(d[("f1_gain", 1)]["value"] - 0.15) < 1e-9
    assert ("feature_set_changed", None) in d
    assert ("recommendation_used", None) in d and ("default_only", None) not in d
    assert d[("best_model", 1)]["value"] == 0.82


def test_best_round_earliest_on_tie(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.7)], "run_id int, iteration int, f1 double")
    assert H.best_round(df).first()["iteration"] == 1


def test_f1_change(history_frame):
    assert abs(H.f1_change(history_frame).first()["f1_change"] - 0.15) < 1e-9


def test_rounds_are_compared_in_order_over_gaps_and_blocks(spark, monkeypatch):
    rows = [(1, i, f"Model: M{i}(a=1)", f1) for i, f1 in ((0, 0.5), (2, 0.4), (3, None), (7, 0.6), (9, 0.6))] + [(2, 5, "Model: X", 0.1)]
    df = spark.createDataFrame(rows, "run_id long, iteration int, model_report string, f1 double")
    want = [(2, 0.5, "M0(a=1)"), (3, 0.4, "M2(a=1)"), (7, 0.0, "M3(a=1)"), (9, 0.6, "M7(a=1)")]
    for block in (1024, 4, 1):
        monkeypatch.setattr(H, "BLOCK", block)
        got = H.previous_round(df).orderBy("iteration").select("iteration", "prev_f1", "prev_model").collect()
        assert [tuple(r) for r in got] == want


def test_findings_name_the_compared_rounds(spark):
    rows = [(1, 0, "Model: A", "", 0.9, 0.8, 0.7, 0.75), (1, 4, "Model: B", "", 0.8, 0.6, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "run_id long, iteration int, model_report string, feature_report string, accuracy double, prec double, recall double, f1 double")
    found = {r.code: r for r in H.diagnose(df, ["f1_regression", "best_model"]).collect()}
    assert tuple(found["f1_regression"])[4:9] == ("B", 0.25, "A", 0.75, 0.5)
    assert tuple(found["best_model"])[4:] == ("A", 0.75, None, None, 0.75, 0.8, 0.7)
