"""Cleaning: numeric coercion, string normalisation, median and
mode fills, target filter, timestamp parsing — in the reference's order.

``Cleaner(roles).fit(df)`` runs the aggregate jobs (exact medians, modes)
over *all* rows, before the target filter (quirk Q1), and returns a
``CleanerModel`` whose ``transform`` is a pure projection + filter that
Catalyst collapses into the scan's stage (no exchange). Because it is a
projection, the fitted model also applies to a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.functions.expressions import (
    STRING_NA, as_number, normalise_text, strip_ws, to_number,
)
from tidewise.functions.quantiles import quantiles
from tidewise.roles import Roles


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Configured columns -> DOUBLE; unparseable text -> NULL."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: as_number(F.col(c), types[c]) for c in cols if c in types})


def normalise_strings(df: DataFrame, cols: list[str], tokens=STRING_NA) -> DataFrame:
    """strip (any white space) + lower-case; ``nan``, ``n/a``, ``none``, empty -> NULL."""
    return df.withColumns({c: normalise_text(F.col(c), tokens) for c in cols if c in df.columns})


def keep_binary(df: DataFrame, target: str) -> DataFrame:
    """Drop rows whose target is missing or not 0/1 (text coerced first)."""
    if target not in df.columns:
        return df
    t = to_number(F.col(target))
    return df.withColumn(target, t).filter(F.col(target).isin(0.0, 1.0))


def parse_timestamps(df: DataFrame, cols: list[str], formats: list[str] | None = None) -> DataFrame:
    """Text -> TIMESTAMP_NTZ (naive, as pandas ``to_datetime``): every ISO
    layout parses; other layouts through ``formats``; bad text -> NULL."""
    out = {c: to_timestamp_text(F.col(c), formats) for c in cols if c in df.columns}
    return df.withColumns(out) if out else df


def to_timestamp_text(c: Column, formats: list[str] | None = None) -> Column:
    s = strip_ws(c.cast("string"))
    parsed = [s.try_cast("timestamp_ntz")]
    for fmt in formats or []:
        parsed.append(F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(*parsed) if len(parsed) > 1 else parsed[0]


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact interpolated median of each column (one bracketing job set)."""
    if not cols:
        return {}
    res = quantiles(df, [(F.col(c), None) for c in cols], [[0.5]] * len(cols))
    return {c: r[0] for c, r in zip(cols, res)}


def fit_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-missing value per column, smallest on a tie.
    One scan: (column, value) pairs -> partial + final group count ->
    per-column ``min_by(value, (-count, value))`` over the distinct values
    only; no value map per group is ever held in one task."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    counted = (df.select(pairs.alias("p")).select("p.*").filter(F.col("v").isNotNull())
               .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    top = counted.groupBy("k").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))).alias("mode"))
    found = {r["k"]: r["mode"] for r in top.collect()}
    return {c: found.get(c) for c in cols}


@dataclass
class CleanerModel:
    roles: Roles
    numeric: list[str]
    strings: list[str]
    medians: dict[str, float | None]
    modes: dict[str, str | None]
    null_numeric: dict[str, int] = field(default_factory=dict)
    null_strings: dict[str, int] = field(default_factory=dict)
    formats: list[str] | None = None

    def fills(self, df: DataFrame) -> DataFrame:
        """Coerce, normalise and fill (no row filter)."""
        df = normalise_strings(coerce_numeric(df, self.numeric), self.strings)
        fill = {}
        for c in self.numeric:
            if self.null_numeric.get(c, 0) > 0 and self.medians.get(c) is not None:
                fill[c] = F.coalesce(F.col(c), F.lit(float(self.medians[c])))
        for c in self.strings:
            if self.null_strings.get(c, 0) > 0 and self.modes.get(c) is not None:
                fill[c] = F.coalesce(F.col(c), F.lit(self.modes[c]))
        return df.withColumns(fill) if fill else df

    def transform(self, df: DataFrame) -> DataFrame:
        df = keep_binary(self.fills(df), self.roles.target)
        return parse_timestamps(df, self.roles.present(df, "timestamps"), self.formats)


class Cleaner:
    def __init__(self, roles: Roles | None = None, formats: list[str] | None = None):
        self.roles = roles or Roles()
        self.formats = formats

    def fit(self, df: DataFrame) -> CleanerModel:
        r = self.roles
        numeric, strings = r.present(df, "numeric"), r.present(df, "categorical")
        prepared = normalise_strings(coerce_numeric(df, numeric), strings)
        # one pass: null counts + the first quantile pass of every numeric column
        nulls: dict = {}
        qs = quantiles(prepared, [(F.col(c), None) for c in numeric], [[0.5]] * len(numeric),
                       extra=[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in numeric + strings]
                       or [F.count(F.lit(1)).alias("_n")], extra_out=nulls)
        null_num = {c: nulls[f"null_{c}"] for c in numeric}
        null_str = {c: nulls[f"null_{c}"] for c in strings}
        medians = {c: q[0] for c, q in zip(numeric, qs) if null_num[c] > 0}
        modes = fit_modes(prepared, [c for c in strings if null_str[c] > 0])
        return CleanerModel(r, numeric, strings, medians, modes, null_num, null_str, self.formats)


def clean(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    return Cleaner(roles).fit(df).transform(df)


def dropped_rows(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    """Rows the target filter removes (missing, unparseable or not 0/1)."""
    t = to_number(F.col(target))
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(~F.coalesce(t.isin(0.0, 1.0), F.lit(False))).alias("dropped_rows"))


def cleaning_report(raw: DataFrame, model: CleanerModel) -> DataFrame:
    """One row per cleaning action: (step_no, step, column, method,
    fill_number, fill_text, rows_affected); shape before / after as the
    last two rows. One aggregate over ``raw`` plus the fitted literals."""
    r = model.roles
    coerced = normalise_strings(coerce_numeric(raw, model.numeric), model.strings)
    valid = F.coalesce(to_number(F.col(r.target)).isin(0.0, 1.0), F.lit(False)) \
        if r.target in raw.columns else F.lit(True)
    stamps = r.present(raw, "timestamps")
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_kept")]
    for c in model.numeric + model.strings:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    for c in stamps:
        ok = to_timestamp_text(F.col(c), model.formats)
        aggs.append(F.count_if(valid & F.col(c).isNotNull() & ok.isNull()).alias(f"badts_{c}"))
    one = coerced.agg(*aggs)
    rows: list[Column] = []
    step = 0

    def add(name, column, method, num, text, affected):
        nonlocal step
        step += 1
        rows.append(F.struct(F.lit(step).alias("step_no"), F.lit(name).alias("step"),
                             F.lit(column).cast("string").alias("column"),
                             F.lit(method).alias("method"),
                             F.lit(num).cast("double").alias("fill_number"),
                             F.lit(text).cast("string").alias("fill_text"),
                             affected.cast("bigint").alias("rows_affected")))

    for c in model.numeric:
        add("coerce_numeric", c, "to_number", None, None, F.lit(0))
    for c in model.strings:
        add("normalise_strings", c, "strip_lower", None, None, F.lit(0))
    for c in model.numeric:
        if model.null_numeric.get(c, 0) > 0:
            add("impute", c, "median", model.medians.get(c), None, F.col(f"null_{c}"))
    for c in model.strings:
        if model.null_strings.get(c, 0) > 0:
            add("impute", c, "mode", None, model.modes.get(c), F.col(f"null_{c}"))
    if r.target in raw.columns:
        add("filter_target", r.target, "keep_0_1", None, None, F.col("_n") - F.col("_kept"))
    for c in stamps:
        add("parse_timestamps", c, "to_timestamp", None, None, F.col(f"badts_{c}"))
    add("shape", None, "rows_before", None, None, F.col("_n"))
    add("shape", None, "rows_after", None, None, F.col("_kept"))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
