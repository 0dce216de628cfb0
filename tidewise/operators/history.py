"""Run history, stop decision and diagnostics over a table with
one row per (run, iteration): ``run_id, iteration, model_name,
model_report, feature_report, accuracy, prec, recall, f1, should_stop``.

Per-run checks are windows or groups. A round is compared with the one before
it in order of iteration, whatever gaps the numbering has: a window per run and
block of BLOCK iterations, and for a block's first round the last round of the
block before, from a table of one row per block. So a run with millions of
rounds is spread over its blocks; per-run flags are algebraic aggregates with
map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.operators.recommend import VALID_FEATURES

# Stop rules of the improvement loop.
F1_THRESHOLD = 0.85
MAX_ITERATIONS = 3

#: Iterations of a run that one window partition holds.
BLOCK = 1024

# what a finding tells besides its value: the compared rounds, the best round's figures
DETAILS = ["previous_model", "previous_f1", "f1", "precision", "recall"]
DIAG_COLS = ["run_id", "iteration", "level", "code", "model", "value", *DETAILS]


def model_label(report: Column) -> Column:
    """First line of the model report without the ``Model: `` prefix."""
    return F.replace(F.split(report, "\n").getItem(0), F.lit("Model: "), F.lit(""))


def _m(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))  # missing metrics count as 0


def append_round(history: DataFrame, rounds: DataFrame) -> DataFrame:
    return history.unionByName(rounds, allowMissingColumns=True)


def features_used(history: DataFrame, report: str = "feature_report") -> DataFrame:
    """Feature names from the ``Created: name = ...`` lines, known names only."""
    names = F.regexp_extract_all(F.col(report), F.lit(r"(?m)^\s*Created:\s*([^=\s]+)"), F.lit(1))
    known = F.array(*[F.lit(f) for f in VALID_FEATURES])
    return history.withColumn("features_used", F.filter(names, lambda x: F.array_contains(known, x)))


def features_available(history: DataFrame, report: str = "feature_report") -> DataFrame:
    """Registry features not used in the round, in registry order."""
    known = F.array(*[F.lit(f) for f in VALID_FEATURES])
    return features_used(history, report).withColumn(
        "features_unused", F.array_except(known, F.col("features_used")))


def model_config(history: DataFrame, report: str = "model_report") -> DataFrame:
    """Model name and hyperparameters from ``Model: Name(a=1, b=2)`` on the
    first line; unmatched -> LogisticRegression(C=1.0). Adds
    ``config_model`` and ``config_params MAP<STRING, STRING>``."""
    first = F.split(F.col(report), "\n").getItem(0)
    pat = r"^Model:\s*(\w+)\((.*?)\)"
    matched = first.rlike(pat)
    name = F.regexp_extract(first, pat, 1)
    inner = F.regexp_extract(first, pat, 2)
    pairs = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p.contains("="))
    params = F.map_from_entries(F.transform(pairs, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("k"),
        F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"))))
    default = F.create_map(F.lit("C"), F.lit("1.0"))
    return history.withColumns({
        "config_model": F.when(matched, name).otherwise(F.lit("LogisticRegression")),
        "config_params": F.when(matched, params).otherwise(default)})


def decide(history: DataFrame, max_iterations: int = MAX_ITERATIONS,
           f1_threshold: float = F1_THRESHOLD) -> DataFrame:
    """Stop / continue per round, in the reference's order of rules."""
    it = F.col("iteration")
    stop_flag = F.coalesce(F.col("should_stop"), F.lit(False))
    reason = (F.when(it >= max_iterations - 1, "max_iterations")
              .when(_m("f1") >= f1_threshold, "f1_threshold")
              .when(stop_flag & (it >= 1), "advisor_stop")
              .otherwise("continue"))
    return history.select("run_id", "iteration", (reason == "continue").alias("should_continue"),
                          (it + 1).cast("int").alias("next_iteration"), reason.alias("reason"))


def best_round(history: DataFrame) -> DataFrame:
    """Highest F1 per run, earliest round on ties (a WindowGroupLimit: each
    task keeps one row per run before the shuffle)."""
    w = Window.partitionBy("run_id").orderBy(F.desc(_m("f1")), F.asc("iteration"))
    return history.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def round_metrics(history: DataFrame) -> DataFrame:
    """Long form: (run_id, iteration, model, metric, value)."""
    wide = history.select("run_id", "iteration", model_label(F.col("model_report")).alias("model"),
                          F.col("accuracy"), F.col("prec").alias("precision"), "recall", "f1")
    return wide.unpivot(["run_id", "iteration", "model"], ["accuracy", "precision", "recall", "f1"],
                        "metric", "value")


def f1_change(history: DataFrame) -> DataFrame:
    """Last F1 minus first F1 per run with more than one round."""
    g = history.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        (F.max_by(_m("f1"), "iteration") - F.min_by(_m("f1"), "iteration")).alias("f1_change"))
    return g.filter("n_rounds > 1").select("run_id", "n_rounds", F.round("f1_change", 6).alias("f1_change"))


def _details(**known: Column) -> list[Column]:
    return [known[c].alias(c) if c in known else F.lit(None).cast("string" if c == "previous_model" else "double").alias(c)
            for c in DETAILS]


def _tagged(df: DataFrame, rules: list[tuple[str, str, Column, Column]], iteration: Column,
            model: Column, **known: Column) -> DataFrame:
    """One pass over ``df``: every row emits one tagged row per rule it
    matches (level, code, value) — several diagnostics, one scan."""
    hits = [F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"),
                                  F.round(value.cast("double"), 6).alias("value")))
            for level, code, cond, value in rules]
    return (df.select("run_id", iteration.cast("int").alias("iteration"), model.alias("model"), *_details(**known),
                      F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("d"))
            .select("run_id", "iteration", "d.level", "d.code", "model", "d.value", *DETAILS))


PER_ROUND = ["zero_recall", "low_recall", "zero_precision", "accuracy_paradox"]
CROSS_ROUND = ["f1_regression", "f1_gain"]
PER_RUN = ["feature_set_changed", "default_only", "recommendation_used"]


def _per_round(history: DataFrame, codes: list[str]) -> DataFrame:
    acc, prec, rec, f1 = _m("accuracy"), _m("prec"), _m("recall"), _m("f1")
    rules = {
        "zero_recall": ("warning", "zero_recall", rec == 0, rec),
        "low_recall": ("warning", "low_recall", (rec > 0) & (rec < 0.3), rec),
        "zero_precision": ("warning", "zero_precision", (prec == 0) & (rec > 0), prec),
        "accuracy_paradox": ("warning", "accuracy_paradox", (acc > 0.85) & (f1 < 0.15), acc),
    }
    return _tagged(history, [rules[c] for c in codes], F.col("iteration"),
                   model_label(F.col("model_report")))


def previous_round(history: DataFrame) -> DataFrame:
    """Each round but a run's first with the F1 and model of the round before
    it, the nearest smaller iteration of the run."""
    own = F.struct(_m("f1").alias("f1"), model_label(F.col("model_report")).alias("model"))
    rounds = history.withColumns({"_block": F.floor(F.col("iteration") / BLOCK), "_own": own})
    inside = F.lag("_own").over(Window.partitionBy("run_id", "_block").orderBy("iteration"))
    last = rounds.groupBy("run_id", "_block").agg(F.max_by("_own", "iteration").alias("_last"))
    before = last.select("run_id", "_block", F.lag("_last").over(Window.partitionBy("run_id").orderBy("_block")).alias("_before"))
    rounds = rounds.withColumn("_inside", inside).join(before, ["run_id", "_block"])
    prev = F.coalesce("_inside", "_before")
    return (rounds.select(*history.columns, prev["f1"].alias("prev_f1"), prev["model"].alias("prev_model"))
            .filter("prev_f1 is not null"))


def _cross_round(history: DataFrame, codes: list[str]) -> DataFrame:
    f1, prev = _m("f1"), F.col("prev_f1")
    rules = {
        "f1_regression": ("warning", "f1_regression", (f1 < prev) & (prev > 0), prev - f1),
        "f1_gain": ("positive", "f1_gain", f1 > prev, f1 - prev),
    }
    return _tagged(previous_round(history), [rules[c] for c in codes], F.col("iteration"),
                   model_label(F.col("model_report")),
                   previous_model=F.col("prev_model"), previous_f1=prev, f1=f1)


def _run_flags(history: DataFrame) -> DataFrame:
    fr = F.coalesce(F.col("feature_report"), F.lit(""))
    n_created = F.size(F.split(fr, "Created:", -1)) - 1
    return history.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.count_distinct(n_created).alias("n_sizes"),
        F.bool_and(F.lower(fr).contains("default feature set")).alias("default_only"),
        F.bool_or(fr.contains("LLM-recommended")).alias("recommended"))


def _per_run(history: DataFrame, codes: list[str]) -> DataFrame:
    flags = _run_flags(history).filter("n_rounds > 1")
    rules = {
        "feature_set_changed": ("insight", "feature_set_changed", F.col("n_sizes") > 1, F.col("n_sizes")),
        "default_only": ("warning", "default_only", F.col("default_only"), F.lit(None)),
        "recommendation_used": ("positive", "recommendation_used",
                                F.col("recommended") & ~F.col("default_only"), F.lit(None)),
    }
    return _tagged(flags, [rules[c] for c in codes], F.lit(None), F.lit(None).cast("string"))


def _best(history: DataFrame) -> DataFrame:
    b = best_round(history).filter(_m("f1") > 0)
    return _tagged(b, [("insight", "best_model", F.lit(True), _m("f1"))], F.col("iteration"),
                   model_label(F.col("model_report")), f1=_m("f1"), precision=_m("prec"), recall=_m("recall"))


CODES = ["zero_recall", "low_recall", "zero_precision", "accuracy_paradox", "f1_regression",
         "f1_gain", "feature_set_changed", "default_only", "recommendation_used", "best_model"]


def diagnose(history: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """All diagnostics as (run_id, iteration, level, code, model, value),
    level in warning / positive / insight. One pass per family: per-round
    checks, the consecutive-round join, per-run flags, best round."""
    codes = codes or CODES
    parts = []
    for family, build in ((PER_ROUND, _per_round), (CROSS_ROUND, _cross_round), (PER_RUN, _per_run)):
        wanted = [c for c in family if c in codes]
        if wanted:
            parts.append(build(history, wanted))
    if "best_model" in codes:
        parts.append(_best(history))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
