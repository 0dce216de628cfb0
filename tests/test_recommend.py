import json

import pytest

from tidewise.operators.recommend import DEFAULT_FEATURES, validate


def _v(spark, text):
    return validate(spark.createDataFrame([(1, text)], "response_id long, response_text string")).first()


GOOD = {"features_to_add": ["log_amount", "is_weekend"],
        "model_config": {"model_name": "GradientBoostingClassifier",
                         "hyperparameters": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 4}},
        "should_stop": False, "reasoning": "why"}


def test_plain_json(spark):
    r = _v(spark, json.dumps(GOOD))
    assert r["ok"] and r["features_to_add"] == ["log_amount", "is_weekend"]
    assert r["n_estimators"] == 200 and r["learning_rate"] == 0.05 and r["max_depth"] == 4
    assert r["reasoning"] == "why"


def test_fenced_and_padded(spark):
    assert _v(spark, "```json\n" + json.dumps(GOOD) + "\n```")["ok"]
    assert _v(spark, "   \n" + json.dumps(GOOD) + "  \n ")["ok"]


def test_not_json_falls_back(spark):
    r = _v(spark, "not json at all")
    assert not r["ok"] and r["features_to_add"] == DEFAULT_FEATURES
    assert r["model_name"] == "RandomForestClassifier" and r["n_estimators"] == 100
    assert r["reasoning"] == "Fallback defaults applied."


def test_unknown_features(spark):
    g = dict(GOOD, features_to_add=["nope", "log_amount"])
    assert _v(spark, json.dumps(g))["features_to_add"] == ["log_amount"]
    g = dict(GOOD, features_to_add=["nope"])
    assert _v(spark, json.dumps(g))["features_to_add"] == DEFAULT_FEATURES


@pytest.mark.parametrize("param,value,expected", [
    ("n_estimators", 3000, 300), ("n_estimators", 2, 50), ("learning_rate", 3.0, 0.3),
    ("learning_rate", 0.001, 0.01), ("max_depth", 100, 10), ("max_depth", 1, 3), ("max_depth", 7.9, 7),
])
def test_clamp(spark, param, value, expected):
    g = json.loads(json.dumps(GOOD))
    g["model_config"]["hyperparameters"][param] = value
    assert _v(spark, json.dumps(g))[param] == expected


def test_unknown_model(spark):
    g = dict(GOOD, model_config={"model_name": "Nope", "hyperparameters": {"C": 3}})
    r = _v(spark, json.dumps(g))
    assert r["model_name"] == "RandomForestClassifier" and r["n_estimators"] == 100


def test_enum(spark):
    ok = {"model_name": "SVC", "hyperparameters": {"C": 2, "kernel": "linear"}}
    bad = {"model_name": "SVC", "hyperparameters": {"C": 2, "kernel": "poly"}}
    assert _v(spark, json.dumps(dict(GOOD, model_config=ok)))["kernel"] == "linear"
    assert _v(spark, json.dumps(dict(GOOD, model_config=bad)))["kernel"] is None


def test_stop_only_boolean(spark):
    assert _v(spark, json.dumps(dict(GOOD, should_stop="yes")))["should_stop"] is False
    assert _v(spark, json.dumps(dict(GOOD, should_stop=True)))["should_stop"] is True


def test_boolean_is_not_a_number(spark):
    g = {"model_config": {"model_name": "LogisticRegression", "hyperparameters": {"C": True}}}
    assert _v(spark, json.dumps(g))["C"] is None
