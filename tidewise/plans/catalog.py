"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key
of SURVEY section 2. Each reads the test tables (through the derived views)
and returns the operator's result with the same column names as its oracle."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import clean as C
from tidewise.operators import features as FT
from tidewise.operators.windows import trailing_avg, velocity
from tidewise.plans import views as V
from tidewise.roles import Roles
from tidewise.sources import fixtures
from tidewise.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
R = V.ROLES


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---- 2.1 sources, typing, preview -----------------------------------------

@query("load_csv")
def _load_csv(spark, sf):
    return S.load_csv(V.lazy(spark, sf))


@query("infer_types")
def _infer_types(spark, sf):
    return S.infer_types(V.loaded(spark, sf))


@query("shape")
def _shape(spark, sf):
    return S.shape(V.lazy(spark, sf))


@query("preview")
def _preview(spark, sf):
    return S.preview(V.lazy(spark, sf), 100, R.key)


@query("coerce_target")
def _coerce_target(spark, sf):
    return S.coerce_target(V.lazy(spark, sf), R.target).select(R.key, R.target)


# ---- 2.3 cleaning -----------------------------------------------------------

@query("clean_numeric")
def _clean_numeric(spark, sf):
    return C.coerce_numeric(V.lazy(spark, sf), R.numeric).select(R.key, *R.numeric)


@query("clean_strings")
def _clean_strings(spark, sf):
    return C.normalise_strings(V.lazy(spark, sf), R.categorical).select(R.key, *R.categorical)


def _filled(spark, sf):
    raw = V.raw(spark, sf)
    return C.Cleaner(R).fit(raw).fills(raw)


@query("impute_median")
def _impute_median(spark, sf):
    return _filled(spark, sf).select(R.key, *R.numeric)


@query("impute_mode")
def _impute_mode(spark, sf):
    return _filled(spark, sf).select(R.key, *R.categorical)


@query("filter_target")
def _filter_target(spark, sf):
    return C.keep_binary(V.lazy(spark, sf), R.target).select(R.key, R.target)


@query("dropped_rows")
def _dropped_rows(spark, sf):
    return C.dropped_rows(V.lazy(spark, sf), R.target)


@query("parse_timestamps")
def _parse_timestamps(spark, sf):
    return C.parse_timestamps(V.lazy(spark, sf), R.timestamps).select(R.key, *R.timestamps)


@query("cleaning_report")
def _cleaning_report(spark, sf):
    raw = V.raw(spark, sf)
    return C.cleaning_report(raw, C.Cleaner(R).fit(raw))


@query("clean")
def _clean(spark, sf):
    return V.clean(spark, sf)


# ---- 2.4 features -------------------------------------------------------------

def _feature_query(name: str) -> Query:
    def run(spark, sf):
        cl = V.clean(spark, sf)
        model = FT.FeatureSet([name], R).fit(cl)
        return model.transform(cl).select(R.key, *model.columns)
    return run


for _name in FT.REGISTRY:
    QUERIES[f"feat_{_name}"] = _feature_query(_name)


@query("feature_select")
def _feature_select(spark, sf):
    cl = V.clean(spark, sf)
    model = FT.FeatureSet(["log_amount", "moon_phase", "is_weekend", "is_new_account"], R).fit(cl)
    return model.transform(cl).select(R.key, *model.columns)


@query("one_hot")
def _one_hot(spark, sf):
    cl = V.clean(spark, sf)
    model = FT.OneHot(R.categorical).fit(cl)
    return model.transform(cl).select(R.key, *model.columns)


@query("drop_non_features")
def _drop_non_features(spark, sf):
    return FT.drop_roles(V.clean(spark, sf), R)


@query("feature_table")
def _feature_table(spark, sf):
    return V.features(spark, sf)


# ---- 2.10 inputs the reference expects ready-made ------------------------------

@query("prior_transactions_24h")
def _prior(spark, sf):
    return velocity(fixtures.events(spark, sf)).select("event_id", "prior_transactions_24h")


@query("avg_amount_7d")
def _avg7(spark, sf):
    return trailing_avg(fixtures.events(spark, sf)).select(
        "event_id", F.round("avg_amount_7d", 6).alias("avg_amount_7d"))


# ---- 2.2 profiling ------------------------------------------------------------------
from tidewise.operators import profile as P  # noqa: E402

# Attribute columns of a transaction (identifiers and event time left out):
# the table on which repeated rows are counted.
ATTRIBUTES = ["user_signup_date", "amount", "avg_amount_7d", "prior_transactions_24h",
              "is_international", "merchant_category", "transaction_type", "device_type", "is_fraud"]


@query("describe_numeric")
def _describe_numeric(spark, sf):
    return P.describe(V.typed(spark, sf))


@query("describe_all")
def _describe_all(spark, sf):
    return P.describe(V.typed(spark, sf), include="all")


@query("target_distribution")
def _target_distribution(spark, sf):
    return P.value_counts(V.typed(spark, sf), R.target).orderBy(F.desc("n"))


@query("target_share")
def _target_share(spark, sf):
    return P.value_shares(V.typed(spark, sf), R.target)


@query("positive_rate_mean")
def _positive_rate_mean(spark, sf):
    return P.positive_rate(V.typed(spark, sf), R.target, "mean")


@query("positive_rate_valid")
def _positive_rate_valid(spark, sf):
    return P.positive_rate(V.typed(spark, sf), R.target, "valid")


@query("missing_by_column")
def _missing_by_column(spark, sf):
    return P.missing(V.typed(spark, sf))


@query("missing_top5")
def _missing_top5(spark, sf):
    return P.missing(V.typed(spark, sf), top=5, places=1)


@query("duplicate_rows")
def _duplicate_rows(spark, sf):
    return P.duplicate_count(V.typed(spark, sf).select(*ATTRIBUTES))


@query("outliers_3sigma")
def _outliers_3sigma(spark, sf):
    return P.outliers(V.typed(spark, sf), target=R.target)


@query("outliers_top3")
def _outliers_top3(spark, sf):
    return P.outliers(V.typed(spark, sf), min_count=10, include_target=True, top=3)


@query("negative_values")
def _negative_values(spark, sf):
    return P.negatives(V.typed(spark, sf))


@query("target_quality")
def _target_quality(spark, sf):
    return P.target_quality(V.typed(spark, sf), R.target)


@query("category_cardinality")
def _category_cardinality(spark, sf):
    return P.cardinality(V.typed(spark, sf), key=R.key)


@query("overview")
def _overview(spark, sf):
    return P.overview(V.typed(spark, sf), R.target)


@query("column_summary")
def _column_summary(spark, sf):
    return P.column_summary(V.typed(spark, sf))


@query("class_imbalance")
def _class_imbalance(spark, sf):
    return P.class_imbalance(V.typed(spark, sf), R.target)


@query("quality_issues")
def _quality_issues(spark, sf):
    return P.issues(V.typed(spark, sf, coerce=False), R.target)


@query("histograms")
def _histograms(spark, sf):
    return P.histograms(V.typed(spark, sf), target=R.target)


@query("correlation_matrix")
def _correlation_matrix(spark, sf):
    return P.correlations(V.typed(spark, sf))


@query("boxplot_by_target")
def _boxplot_by_target(spark, sf):
    return P.box_stats(V.typed(spark, sf), by=R.target)


@query("data_summary")
def _data_summary(spark, sf):
    return P.data_summary(V.typed(spark, sf), R.key)


# the same steps on tables with other columns and targets (roles inferred)

def _lineitem(spark, sf):
    df = fixtures.table(spark, sf, "lineitem")
    return df.withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))


@query("describe_lineitem")
def _describe_lineitem(spark, sf):
    df = _lineitem(spark, sf)
    return P.describe(df, Roles.infer(df, "returned").numeric)


@query("box_lineitem")
def _box_lineitem(spark, sf):
    df = _lineitem(spark, sf)
    roles = Roles.infer(df, "returned", "l_orderkey")
    return P.box_stats(df, [c for c in roles.numeric if c.startswith("l_") and not c.endswith("key")], roles.target)


@query("split_documents")
def _split_documents(spark, sf):
    labels = fixtures.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    df = fixtures.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    roles = Roles.infer(df, "quality", "doc_id")
    return M.stratified_split(df, roles.target, roles.key).select("doc_id", "quality", "split")


# ---- 2.6 evaluation ---------------------------------------------------------------------
from tidewise.operators import evaluate as E  # noqa: E402

for _metric in ("accuracy", "precision", "recall", "f1"):
    def _metric_query(spark, sf, _m=_metric):
        return E.evaluate(V.scored(spark, sf)).select(_m)
    QUERIES[f"metric_{_metric}"] = _metric_query


@query("confusion_matrix")
def _confusion_matrix(spark, sf):
    return E.confusion(V.scored(spark, sf))


@query("classification_report")
def _classification_report(spark, sf):
    return E.class_report(V.scored(spark, sf))


@query("evaluate_grouped")
def _evaluate_grouped(spark, sf):
    return E.evaluate(V.scored(spark, sf), by=["transaction_type"])


# ---- 2.7 recommendations -------------------------------------------------------------------
from tidewise.operators import recommend as RC  # noqa: E402


def _validated(spark, sf):
    v = RC.validate(V.responses(spark, sf))
    return v.withColumn("features_to_add", F.array_join("features_to_add", ","))


@query("parse_responses")
def _parse_responses(spark, sf):
    return RC.parse_responses(V.responses(spark, sf)).select("response_id", "body", "ok")


@query("valid_features")
def _valid_features(spark, sf):
    return _validated(spark, sf).select("response_id", "features_to_add")


@query("valid_model")
def _valid_model(spark, sf):
    return _validated(spark, sf).select("response_id", "model_name")


@query("clamp_hyperparameters")
def _clamp(spark, sf):
    return _validated(spark, sf).select("response_id", "model_name", *RC.PARAMS)


@query("valid_stop")
def _valid_stop(spark, sf):
    return _validated(spark, sf).select("response_id", "should_stop")


@query("validate_recommendations")
def _validate_recommendations(spark, sf):
    return _validated(spark, sf)


# ---- 2.8 history, decision, diagnostics -----------------------------------------------------
from tidewise.operators import history as H  # noqa: E402


@query("history_append")
def _history_append(spark, sf):
    h = V.history(spark, sf)
    latest = h.filter("iteration >= 5")
    return H.append_round(h.filter("iteration < 5"), latest.select(*reversed(latest.columns)))


@query("history_features")
def _history_features(spark, sf):
    return H.features_used(V.history(spark, sf)).select(
        "run_id", "iteration", F.array_join("features_used", ",").alias("features_used"))


@query("history_unused_features")
def _history_unused(spark, sf):
    return H.features_available(V.history(spark, sf)).select(
        "run_id", "iteration", F.array_join("features_unused", ",").alias("features_unused"))


@query("history_model_config")
def _history_model_config(spark, sf):
    h = H.model_config(V.history(spark, sf))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("config_params"),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    return h.select("run_id", "iteration", "config_model", text.alias("config_params"))


@query("decide")
def _decide(spark, sf):
    return H.decide(V.history(spark, sf))


@query("best_round")
def _best_round(spark, sf):
    return H.best_round(V.history(spark, sf)).select("run_id", "iteration", "model_name", "f1",
                                                     "accuracy", "prec", "recall")


@query("round_metrics")
def _round_metrics(spark, sf):
    return H.round_metrics(V.history(spark, sf))


@query("f1_change_total")
def _f1_change_total(spark, sf):
    return H.f1_change(V.history(spark, sf))


for _code in H.CODES:
    def _diag_query(spark, sf, _c=_code):
        return H.diagnose(V.history(spark, sf), [_c])
    QUERIES[f"diag_{_code}"] = _diag_query


@query("diagnose")
def _diagnose(spark, sf):
    return H.diagnose(V.history(spark, sf))


# ---- 2.5 split, scaling, training, scoring ------------------------------------------------------
from tidewise.operators import modeling as M  # noqa: E402

# Fixed parameters of the linear_score query (a hand-set linear rule).
SCORE_COEF = {"amount": 0.02, "amount_to_avg_ratio": 0.5, "is_high_amount": 1.0, "hour_of_day": -0.01}
SCORE_INTERCEPT = -2.5


def _fk(spark, sf):
    return V.features(spark, sf, keep_key=True)


def _feature_cols(df):
    return [c for c in df.columns if c not in (R.key, R.target)]


@query("fill_zero")
def _fill_zero(spark, sf):
    df = _fk(spark, sf)
    return M.fill_zero(df, _feature_cols(df))


def _split(spark, sf):
    df = _fk(spark, sf)
    return M.stratified_split(M.fill_zero(df, _feature_cols(df)), R.target, R.key)


@query("stratified_split")
def _stratified_split(spark, sf):
    return _split(spark, sf).select(R.key, R.target, "split")


@query("balanced_weights")
def _balanced_weights(spark, sf):
    tr = _split(spark, sf).filter("split = 'train'")
    return M.balanced_weights(tr, R.target).select(R.key, R.target, F.round("weight", 6).alias("weight"))


@query("standard_scale")
def _standard_scale(spark, sf):
    sp = _split(spark, sf)
    feats = _feature_cols(sp.drop("split"))
    scaled = M.Scaler(feats).fit(sp.filter("split = 'train'")).transform(sp)
    return scaled.select(R.key, "split", *[F.round(c, 6).alias(c) for c in feats])


@query("assemble")
def _assemble(spark, sf):
    df = _fk(spark, sf)
    feats = _feature_cols(df)
    return M.to_array(M.assemble(M.fill_zero(df, feats), feats)).select(R.key, "features")


def _train_query(config):
    def run(spark, sf):
        return M.train(_fk(spark, sf), R.target, R.key, config).test_predictions()
    return run


QUERIES["train_logistic"] = _train_query({"model_name": "LogisticRegression", "hyperparameters": {"C": 1.0}})
QUERIES["train_random_forest"] = _train_query({"model_name": "RandomForestClassifier",
                                               "hyperparameters": {"n_estimators": 100}})
QUERIES["train_gbt"] = _train_query({"model_name": "GradientBoostingClassifier", "hyperparameters": {}})
QUERIES["train_svc_linear"] = _train_query({"model_name": "SVC", "hyperparameters": {"C": 1.0, "kernel": "linear"}})
QUERIES["train_svc_rbf"] = _train_query({"model_name": "SVC", "hyperparameters": {"C": 1.0}})
QUERIES["train_svc_rbf_exact"] = _train_query({"model_name": "SVC", "hyperparameters": {"C": 1.0, "exact": True}})
QUERIES["train"] = _train_query(None)


#: Largest gradient entry at which a logistic fit counts as optimal.
OPTIMAL = 1e-4


@query("optimality_logistic")
def _optimality_logistic(spark, sf):
    trained = M.train(_fk(spark, sf), R.target, R.key, {"model_name": "LogisticRegression", "hyperparameters": {"C": 1.0}})
    return M.logistic_gradient(trained).select("term", F.lit(trained.n_train).cast("bigint").alias("n_train"),
                                               (F.abs("gradient") <= OPTIMAL).alias("optimal"))


@query("predict")
def _predict(spark, sf):
    trained = M.train(_fk(spark, sf), R.target, R.key)
    return trained.predict(trained.split.filter("split = 'test'"))


@query("linear_score")
def _linear_score(spark, sf):
    out = E.linear_score(V.features(spark, sf, keep_key=True), SCORE_COEF, SCORE_INTERCEPT)
    return out.select(R.key, F.round("score", 6).alias("score"), "prediction")


@query("feature_importance")
def _feature_importance(spark, sf):
    return M.train(_fk(spark, sf), R.target, R.key,
                   {"model_name": "RandomForestClassifier", "hyperparameters": {"n_estimators": 50}}).importance()


# ---- 2.9 the improvement loop --------------------------------------------------------------------
from tidewise.plans import loop as LP  # noqa: E402


@query("profile_and_clean")
def _profile_and_clean(spark, sf):
    return LP.analysis_report(LP.analyse(V.raw(spark, sf), R))


@query("improve_loop")
def _improve_loop(spark, sf):
    return LP.improve(V.clean(spark, sf), R)
