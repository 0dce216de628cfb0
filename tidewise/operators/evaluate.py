"""Evaluation of predictions. Input: any table with a label
and a prediction column; positive class = 1. Every metric is one partial +
final aggregate (``groupBy`` adds segments without changing the plan
shape)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _metrics(label: Column, pred: Column, places: int = 4) -> list[Column]:
    tp = F.count_if((label == 1) & (pred == 1))
    fp = F.count_if((label != 1) & (pred == 1))
    fn = F.count_if((label == 1) & (pred != 1))
    correct = F.count_if(label == pred)
    n = F.count(F.lit(1))
    return [F.round(_ratio(correct, n), places).alias("accuracy"),
            F.round(_ratio(tp, tp + fp), places).alias("precision"),
            F.round(_ratio(tp, tp + fn), places).alias("recall"),
            F.round(_ratio(2 * tp, 2 * tp + fp + fn), places).alias("f1")]


def evaluate(df: DataFrame, by: list[str] | None = None, label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, F1 (4 decimals, 0 when undefined)."""
    m = _metrics(F.col(label).cast("double"), F.col(prediction).cast("double"))
    return df.groupBy(*by).agg(*m) if by else df.agg(*m)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by (true, predicted) over the sorted union of classes, zeros
    included. The class list is a distributed distinct; the k x k grid is
    generated from it by two explodes (no join of the data with itself)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    counts = df.groupBy(y.alias("label"), p.alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    classes = (counts.select(F.explode(F.array("label", "prediction")).alias("c"))
               .filter("c IS NOT NULL").distinct()
               .agg(F.sort_array(F.collect_list("c")).alias("cs")))
    grid = (classes.select(F.explode("cs").alias("label"), "cs")
            .select("label", F.explode("cs").alias("prediction")))
    return (grid.join(F.broadcast(counts), ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n")))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 places: int = 4) -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro
    and weighted averages — computed from the (small) confusion table."""
    cm = confusion(df, label, prediction)
    per = cm.groupBy(F.col("label").alias("c")).agg(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pred_tot = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("pred"))
    per = per.join(pred_tot, "c")
    prec = _ratio(F.col("tp"), F.col("pred"))
    rec = _ratio(F.col("tp"), F.col("support"))
    per = per.select("c", prec.alias("p"), rec.alias("r"),
                     _ratio(2 * F.col("tp"), F.col("pred") + F.col("support")).alias("f"),
                     "support", "tp")
    rows = per.select(F.col("c").cast("string").alias("class"), F.round("p", places).alias("precision"),
                      F.round("r", places).alias("recall"), F.round("f", places).alias("f1"),
                      F.col("support").cast("bigint").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f").alias("mf"),
                  F.sum(F.col("p") * F.col("support")).alias("wp"),
                  F.sum(F.col("r") * F.col("support")).alias("wr"),
                  F.sum(F.col("f") * F.col("support")).alias("wf"))
    n = F.col("n")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.round(_ratio(F.col("tp"), n), places).alias("f1"), n.cast("bigint").alias("support")),
        _row("macro avg", F.round("mp", places), F.round("mr", places), F.round("mf", places), n),
        _row("weighted avg", F.round(_ratio(F.col("wp"), n), places),
             F.round(_ratio(F.col("wr"), n), places), F.round(_ratio(F.col("wf"), n), places), n)
    )).alias("s")).select("s.*")
    return rows.unionByName(summary)


def _row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
    return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                    f.alias("f1"), n.cast("bigint").alias("support"))


def linear_score(df: DataFrame, coef: dict[str, float], intercept: float = 0.0,
                 threshold: float = 0.0) -> DataFrame:
    """Score and 0/1 prediction of a given linear model: a sum of column
    products (missing values count as 0), no UDF."""
    s = F.lit(float(intercept))
    for c, w in coef.items():
        s = s + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return df.withColumn("score", s).withColumn(
        "prediction", F.when(F.col("score") > threshold, 1.0).otherwise(0.0))
