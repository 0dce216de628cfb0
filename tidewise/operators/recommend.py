"""Validation of recommendation texts, as one batch job over a
table of responses ``(response_id, response_text)``.

Parsing uses VARIANT (``try_parse_json``): a fixed ``from_json`` schema
would hide type errors (``"5"`` for a number, a string for a list).
Every rule is a column expression, so the whole validation is one
projection — no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The feature names a recommendation may use, in registry order.
VALID_FEATURES = [
    "account_age_days", "hour_of_day", "day_of_week", "amount_to_avg_ratio",
    "is_high_amount", "log_amount", "is_new_account", "is_night_txn",
    "amount_deviation", "high_velocity", "amount_squared",
    "amount_x_velocity", "is_weekend", "txn_per_avg_ratio",
]

# Models and hyperparameter ranges (int bounds mean an int
# parameter; a list means allowed values).
VALID_MODELS = {
    "LogisticRegression": {"C": (0.01, 10.0)},
    "RandomForestClassifier": {"n_estimators": (50, 300), "max_depth": (5, 30)},
    "GradientBoostingClassifier": {
        "n_estimators": (50, 300),
        "learning_rate": (0.01, 0.3),
        "max_depth": (3, 10),
    },
    "SVC": {"C": (0.1, 10.0), "kernel": ["rbf", "linear"]},
}

# The recommendation used when a reply cannot be used.
DEFAULT_FEATURES = VALID_FEATURES[:7]
DEFAULT_MODEL = "RandomForestClassifier"
DEFAULT_HYPERPARAMETERS = {"n_estimators": 100}
FALLBACK_REASONING = "Fallback defaults applied."

# Output columns for hyperparameters: name -> Spark type.
PARAMS = {"C": "double", "n_estimators": "bigint", "max_depth": "bigint",
          "learning_rate": "double", "kernel": "string"}

_HWS = r"[^\S\n]*"
_NUMERIC_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Strip; when fenced, drop every line that starts with a fence."""
    s = _strip(c)
    unfenced = _strip(F.regexp_replace(s, r"(?m)^" + _HWS + r"```[^\n]*(\n|$)", ""))
    return F.when(s.startswith("```"), unfenced).otherwise(s)


def _kind(v: Column) -> Column:
    """Top-level JSON kind of a variant: OBJECT / ARRAY / STRING / BOOLEAN / NUMBER / NULL."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(t.startswith("OBJECT"), "OBJECT").when(t.startswith("ARRAY"), "ARRAY")
            .when(t == "STRING", "STRING").when(t == "BOOLEAN", "BOOLEAN")
            .when(t.isin(*_NUMERIC_TYPES) | t.startswith("DECIMAL"), "NUMBER")
            .otherwise("NULL"))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parse_responses(df: DataFrame, text: str = "response_text") -> DataFrame:
    """Adds ``body`` (cleaned text), ``raw`` (VARIANT or NULL) and ``ok``
    (the text is a JSON object)."""
    return (df.withColumn("body", clean_text(F.col(text))).withColumn("raw", F.try_parse_json(F.col("body")))
            .withColumn("ok", F.coalesce(_kind(F.col("raw")) == "OBJECT", F.lit(False))))


def valid_features(raw: Column, ok: Column) -> Column:
    """Known names only, in order; not a list or nothing left -> default seven."""
    arr = F.try_variant_get(raw, "$.features_to_add", "array<variant>")
    names = F.transform(arr, lambda e: F.when(_kind(e) == "STRING", F.try_variant_get(e, "$", "string")))
    known = F.filter(names, lambda x: F.array_contains(F.array(*[F.lit(f) for f in VALID_FEATURES]), x))
    is_list = _kind(_get(raw, "$.features_to_add")) == "ARRAY"
    default = F.array(*[F.lit(f) for f in DEFAULT_FEATURES])
    return F.when(ok & is_list & (F.size(known) > 0), known).otherwise(default)


def valid_model(raw: Column, ok: Column) -> Column:
    name = F.when(_kind(_get(raw, "$.model_config")) == "OBJECT",
                  F.when(_kind(_get(raw, "$.model_config.model_name")) == "STRING",
                         F.try_variant_get(raw, "$.model_config.model_name", "string")))
    return F.when(ok & name.isin(*VALID_MODELS), name).otherwise(F.lit(DEFAULT_MODEL))


def uses_hyperparameters(raw: Column, ok: Column) -> Column:
    """Whether a reply's hyperparameters count: its model is a known one and
    they are an object or missing."""
    mc_ok = ok & (_kind(_get(raw, "$.model_config")) == "OBJECT")
    name_valid = mc_ok & F.try_variant_get(raw, "$.model_config.model_name", "string").isin(*VALID_MODELS)
    hp_obj = _kind(_get(raw, "$.model_config.hyperparameters")) == "OBJECT"
    hp_absent = _get(raw, "$.model_config.hyperparameters").isNull()
    return F.coalesce(name_valid & (hp_obj | hp_absent), F.lit(False))  # missing -> {}


def clamp_hyperparameters(raw: Column, model: Column, use_hp: Column) -> dict[str, Column]:
    """One column per hyperparameter, from the columns ``valid_model`` and
    ``uses_hyperparameters``: kept only for the chosen model,
    numbers (JSON numbers only; booleans and text are not) clamped into the
    range and cast to its type (int: truncation), enum values outside the
    list dropped. A valid model whose hyperparameters are not an object
    keeps the default {n_estimators: 100}."""
    out = {}
    for p, typ in PARAMS.items():
        path = f"$.model_config.hyperparameters.{p}"
        kind = _kind(_get(raw, path))
        rules = {m: spec[p] for m, spec in VALID_MODELS.items() if p in spec}
        ranges = {m: r for m, r in rules.items() if isinstance(r, tuple)}
        if ranges:  # the model's limits by one small map, the value read once
            limits = F.create_map(*[x for m, (lo, hi) in ranges.items()
                                    for x in (F.lit(m), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
            limit = F.try_element_at(limits, model)
            x = F.try_variant_get(raw, path, "double")
            kept = F.when((kind == "NUMBER") & limit.isNotNull(), F.greatest(limit["lo"], F.least(limit["hi"], x)).cast(typ))
        else:
            s = F.try_variant_get(raw, path, "string")
            kept = F.when((kind == "STRING") & F.lit(False), s)
            for m, allowed in rules.items():
                kept = F.when((model == m) & (kind == "STRING") & s.isin(*allowed), s).otherwise(kept)
        default = DEFAULT_HYPERPARAMETERS.get(p)
        fallback = F.lit(default).cast(typ) if default is not None else F.lit(None).cast(typ)
        out[p] = F.when(use_hp, kept).otherwise(fallback).cast(typ)
    return out


def valid_stop(raw: Column, ok: Column) -> Column:
    """Only a JSON boolean counts; the text "yes" is not a stop."""
    v = _get(raw, "$.should_stop")
    return F.coalesce(ok & (_kind(v) == "BOOLEAN") & F.try_variant_get(raw, "$.should_stop", "boolean"),
                      F.lit(False))


def reasoning(raw: Column, ok: Column) -> Column:
    v = _get(raw, "$.reasoning")
    text = F.when(_kind(v) == "STRING", F.try_variant_get(raw, "$.reasoning", "string")) \
        .otherwise(F.to_json(v))
    return F.when(~ok, F.lit(FALLBACK_REASONING)).otherwise(F.coalesce(text, F.lit("")))


def validate(df: DataFrame, text: str = "response_text") -> DataFrame:
    """All rules as one projection: features, model, hyperparameters,
    stop flag, reasoning; the fallback recommendation where parsing failed."""
    raw, ok = F.col("raw"), F.col("ok")
    p = parse_responses(df, text).withColumns({"_model": valid_model(raw, ok), "_use_hp": uses_hyperparameters(raw, ok)})
    hp = clamp_hyperparameters(raw, F.col("_model"), F.col("_use_hp"))
    return p.select(
        *[c for c in df.columns if c != text], "ok",
        valid_features(raw, ok).alias("features_to_add"),
        F.col("_model").alias("model_name"),
        *[c.alias(n) for n, c in hp.items()],
        valid_stop(raw, ok).alias("should_stop"),
        reasoning(raw, ok).alias("reasoning"))
