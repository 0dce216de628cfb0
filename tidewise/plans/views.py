"""Derived inputs shared by the registered queries: the fixture views and
the loaded / typed / clean / feature tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewise.operators.clean import Cleaner
from tidewise.operators.features import build_features
from tidewise.roles import Roles
from tidewise.session import shared
from tidewise.sources import fixtures
from tidewise.sources.tables import apply_types, coerce_target, fit_types, load_csv

ROLES = Roles()


def lazy(spark: SparkSession, sf: str) -> DataFrame:
    """The raw view as a plan: queries that read it once only compute the
    columns they use."""
    return fixtures.raw(spark, sf)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The raw view, written once per session and source: for steps whose fit
    passes and transform would otherwise run the window several times."""
    return shared(spark, "raw", f"{sf}/events.parquet", lambda: fixtures.raw(spark, sf))


def loaded(spark: SparkSession, sf: str) -> DataFrame:
    """``raw`` through the CSV missing-token step (what pandas would read)."""
    return load_csv(raw(spark, sf))


def typed(spark: SparkSession, sf: str, coerce: bool = True) -> DataFrame:
    """``loaded`` with inferred column types and the target coerced (unless
    told otherwise): the frame the profiling steps see."""
    df = loaded(spark, sf)
    df = apply_types(df, fit_types(df))
    return coerce_target(df, ROLES.target) if coerce else df


def clean(spark: SparkSession, sf: str) -> DataFrame:
    r = raw(spark, sf)
    return Cleaner(ROLES).fit(r).transform(r)


def features(spark: SparkSession, sf: str, names: list[str] | None = None,
             keep_key: bool = False) -> DataFrame:
    """The modelling table, from the clean table written once per session and
    source: its fit passes would otherwise clean every row again."""
    stored = shared(spark, "clean", f"{sf}/events.parquet", lambda: clean(spark, sf))
    return build_features(stored, names, ROLES, [ROLES.key] if keep_key else None)


def history(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.history(spark, sf)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.responses(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by a fixed rule over the clean table (label = target),
    so every evaluation step has an SQL oracle."""
    from pyspark.sql import functions as F
    c = clean(spark, sf)
    return c.select("transaction_id", "transaction_type", "device_type",
                    F.col(ROLES.target).alias("label"),
                    F.when(F.col("amount") > 100, 1.0).otherwise(0.0).alias("prediction"))
