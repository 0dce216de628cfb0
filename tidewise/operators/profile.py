"""Profiling: exploration and data quality.

Rule: one wide aggregate per question, never an unpivot of the data
itself. Per-column results are produced by aggregating first (one row) and
then exploding that single row into one row per column. Exact quantiles go
through ``functions.quantiles`` (bounded memory); distinct counts and
top values through distributed group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.functions.expressions import as_number, safe_corr
from tidewise.functions.grouped import group_quantiles, join_groups
from tidewise.functions.quantiles import quantiles

NUMERIC_TYPES = (T.NumericType,)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name != exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _rows(one: DataFrame, entries: list[Column]) -> DataFrame:
    """Explode a one-row aggregate into one row per struct in ``entries``."""
    return one.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def _r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- describe ----------------------------------------------------------------

def describe(df: DataFrame, cols: list[str] | None = None, include: str = "number") -> DataFrame:
    """pandas ``describe``: count, mean, std (n-1), min, quartiles, max per
    numeric column; with ``include="all"`` also unique / top / freq for
    string columns. Quartiles are exact (interpolated). The moments ride
    along in the first quantile pass, so a numeric describe reads the table
    twice (plus one group count for string top values)."""
    num = cols or numeric_columns(df)
    strs = string_columns(df) if include == "all" else []
    allc = [f.name for f in df.schema.fields if f.name in set(num) | set(strs)]
    aggs = []
    for i, c in enumerate(allc):
        aggs.append(F.count(_c(c)).alias(f"n{i}"))
        if c in num:
            x = _c(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row: dict = {}
    qs = quantiles(df, [(_c(c), None) for c in num], [[0.25, 0.5, 0.75]] * len(num),
                   extra=aggs, extra_out=row)
    qmap = dict(zip(num, qs))
    tops = top_values(df, strs) if strs else {}
    r6 = _round_half_up
    out = []
    for i, c in enumerate(allc):
        if c in qmap:
            q = qmap[c]
            out.append((c, row[f"n{i}"], None, None, None, r6(row[f"m{i}"]), r6(row[f"s{i}"]),
                        row[f"lo{i}"], r6(q[0]), r6(q[1]), r6(q[2]), row[f"hi{i}"]))
        else:
            top, freq, unique = tops.get(c, (None, None, 0))
            out.append((c, row[f"n{i}"], unique, top, freq) + (None,) * 7)
    schema = ("column string, count bigint, unique bigint, top string, freq bigint, mean double, "
              "std double, min double, q25 double, q50 double, q75 double, max double")
    res = df.sparkSession.createDataFrame(out, schema)
    return res if include == "all" else res.drop("unique", "top", "freq")


def _round_half_up(v: float | None, places: int = 6) -> float | None:
    """Round like Spark's ``round``: half-up on the shortest decimal form."""
    from decimal import ROUND_HALF_UP, Decimal
    if v is None:
        return None
    return float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


def value_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """(k, v, n): how often each value (as text) of each column occurs, one
    shuffle of (column, value) counts with map-side combine."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _c(c).cast("string").alias("v"))
                                for c in cols]))
    return (df.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL")
            .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))


def top_values(df: DataFrame, cols: list[str]) -> dict[str, tuple[str | None, int | None, int]]:
    """Per column the most frequent value (the smallest on a tie), its count
    and the number of different values."""
    if not cols:
        return {}
    best = value_groups(df, cols).groupBy("k").agg(
        F.min_by(F.struct("v", "n"), F.struct((-F.col("n")).alias("m"), F.col("v"))).alias("b"),
        F.count(F.lit(1)).alias("u"))
    found = {r["k"]: (r["b"]["v"], r["b"]["n"], r["u"]) for r in best.collect()}
    return {c: found.get(c, (None, None, 0)) for c in cols}


# ---- target --------------------------------------------------------------------

def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-missing value (order with ``orderBy`` as wanted)."""
    return df.filter(_c(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and percent share (1 decimal) per non-missing value."""
    vc = value_counts(df, col)
    total = F.sum("n").over(_whole())
    return vc.select(col, "n", F.round(F.col("n") * 100.0 / total, 1).alias("share"))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def positive_rate(df: DataFrame, target: str, rule: str = "valid") -> DataFrame:
    """``mean``: mean of the target x 100 (stray values count);
    ``valid``: share of ``== 1`` among non-missing x 100 (0 when none)."""
    t = _c(target).cast("double")
    if rule == "mean":
        return df.agg(_r6(F.avg(t) * 100).alias("positive_rate"))
    return df.agg(_r6(F.coalesce(F.try_divide(F.count_if(t == 1) * 100.0, F.count(t)),
                                 F.lit(0.0))).alias("positive_rate"))


def target_quality(df: DataFrame, target: str) -> DataFrame:
    """Distinct target values (sorted), their number, missing count and values
    outside {0, 1}. Distinct values come from a distributed group-by; the two
    lists in the result are as long as there are different values."""
    t = _c(target).cast("double")
    vals = df.filter(t.isNotNull()).groupBy(t.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stats = vals.agg(F.count(F.lit(1)).alias("n_distinct"),
                     F.count_if(~F.col("v").isin(0.0, 1.0)).alias("n_unexpected"),
                     F.sort_array(F.collect_list("v")).alias("vals"))
    missing = df.agg(F.count_if(t.isNull()).alias("n_missing"))
    tostr = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return (stats.crossJoin(missing)
            .select("n_distinct", tostr(F.col("vals")).alias("distinct_values"), "n_missing",
                    "n_unexpected",
                    tostr(F.filter("vals", lambda x: ~x.isin(0.0, 1.0))).alias("unexpected_values")))


# ---- missing / duplicates / outliers ------------------------------------------

def _missing_one(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(_c(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])


def missing(df: DataFrame, top: int | None = None, places: int = 2) -> DataFrame:
    """Per column with missing values: count and percent of rows, worst
    first. With ``top``: (rank, column, missing, pct, more_columns)."""
    one = _missing_one(df)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"m{i}").alias("missing"),
                        F.round(F.col(f"m{i}") * 100.0 / F.col("_n"), places).alias("pct"))
               for i, c in enumerate(df.columns)]
    rows = _rows(one, entries).filter("missing > 0")
    if top is None:
        return rows.drop("position")
    from pyspark.sql import Window
    w = Window.partitionBy().orderBy(F.desc("missing"), F.asc("position"))
    ranked = rows.select("*", F.row_number().over(w).alias("rank"), F.count(F.lit(1)).over(
        Window.partitionBy()).alias("_k"))
    return (ranked.filter(F.col("rank") <= top)
            .select(F.col("rank").cast("int"), "column", "missing", "pct",
                    F.greatest(F.col("_k") - top, F.lit(0)).alias("more_columns")))


def duplicate_count(df: DataFrame, method: str = "hash") -> DataFrame:
    """Rows that repeat an earlier row in every column (NULL equals NULL).

    ``hash`` (default): pass 1 shuffles only a 64-bit row hash with partial
    counts; pass 2 groups full rows, but only those whose hash repeats, so
    collisions are re-checked and the count stays exact while a wide table
    is never shuffled whole. ``direct``: one group-by on all columns.
    Both collapse copies map-side, so a row repeated a billion times costs
    one row per task in the shuffle."""
    cols = [_c(c) for c in df.columns]
    if method == "direct":
        groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))
        return groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    # NULL-aware row hash: a NULL field and an empty value hash differently
    h = F.xxhash64(*[F.struct(c.isNull().alias("n"), c.alias("v")) for c in cols])
    hashed = df.select("*", h.alias("_h"))
    repeated = (hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("_h"))
    candidates = hashed.join(repeated, "_h", "left_semi").drop("_h")
    groups = candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))
    return groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _moments(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.count(x).alias(f"cnt{i}")]
    return df.agg(*aggs)


def outliers(df: DataFrame, cols: list[str] | None = None, k: float = 3.0, min_count: int = 0,
             target: str | None = None, include_target: bool = False,
             top: int | None = None) -> DataFrame:
    """Per numeric column: number of values with |x - mean| > k * std
    (sample std, only where std > 0 and at least ``min_count`` values);
    columns with none are left out. Pass 1 is a one-row aggregate that is
    broadcast to pass 2 (no shuffle of the data)."""
    cols = cols or numeric_columns(df, None if include_target else target)
    if not cols:
        schema = ("rank int, column string, n_outliers bigint" if top is not None
                  else "column string, n_outliers bigint")
        return df.sparkSession.createDataFrame([], schema)
    stats = _moments(df, cols)
    joined = df.select(*[_c(c) for c in cols]).crossJoin(F.broadcast(stats))
    aggs = []
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        cond = (F.col(f"std{i}") > 0) & (F.abs(x - F.col(f"mean{i}")) > k * F.col(f"std{i}"))
        aggs.append(F.count_if(cond).alias(f"o{i}"))
        aggs.append(F.first(F.col(f"cnt{i}")).alias(f"c{i}"))
    one = joined.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"o{i}").alias("n_outliers"), F.col(f"c{i}").alias("_cnt"))
               for i, c in enumerate(cols)]
    rows = _rows(one, entries).filter((F.col("n_outliers") > 0) & (F.col("_cnt") >= min_count))
    if top is None:
        return rows.select("column", "n_outliers")
    from pyspark.sql import Window
    w = Window.partitionBy().orderBy(F.desc("n_outliers"), F.asc("position"))
    return (rows.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= top)
            .select(F.col("rank").cast("int"), "column", "n_outliers"))


def negatives(df: DataFrame, cols=("amount", "avg_amount_7d", "prior_transactions_24h")) -> DataFrame:
    """Negative values in columns expected to be non-negative (text parsed)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in cols if c in types]
    one = df.agg(*[F.count_if(as_number(_c(c), types[c]) < 0).alias(f"g{i}") for i, c in enumerate(cols)])
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"g{i}").alias("negatives"))
                       for i, c in enumerate(cols)])


# ---- categorical ------------------------------------------------------------------

def cardinality(df: DataFrame, cols: list[str] | None = None, key: str = "transaction_id",
                sample: int = 5) -> DataFrame:
    """Per string column: distinct count and the first ``sample`` distinct
    values in ``key`` order. (column, value) pairs are grouped once; the
    per-column first-k is a WindowGroupLimit (partial top-k before the
    shuffle)."""
    from pyspark.sql import Window
    cols = cols or [c for c in string_columns(df) if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                                         _c(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    grouped = (df.select(_c(key).alias("_key"), pairs.alias("p"))
               .select("_key", "p.*").filter("v IS NOT NULL")
               .groupBy("pos", "column", "v").agg(F.min("_key").alias("first_key")))
    # count(first_key) keeps this branch's subtree identical to the one
    # below, so the scan + exchange of ``grouped`` is planned once and reused
    counts = grouped.groupBy("pos", "column").agg(F.count("first_key").alias("n_unique"))
    w = Window.partitionBy("pos").orderBy("first_key")
    firsts = (grouped.select("*", F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= sample)
              .groupBy("pos").agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("_rn", "v"))), lambda s: s["v"]), ", ")
                  .alias("sample")))
    return counts.join(firsts, "pos").select("column", "n_unique", "sample")


# ---- summary tables ------------------------------------------------------------------

def column_summary(df: DataFrame) -> DataFrame:
    """Per column: type, non-missing count, % missing (1 decimal), distinct
    count. Counts are one plain aggregate; distinct values come from the
    (column, value) group count, not from a copy of each row per column."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(_c(c)).alias(f"nn{i}"))
    one = df.agg(*aggs)
    rows = _rows(one, [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("type"),
                                F.col(f"nn{i}").alias("non_null"),
                                F.round(F.try_divide((F.col("_n") - F.col(f"nn{i}")) * 100.0, F.col("_n")), 1)
                                .alias("missing_pct"))
                       for i, (c, f) in enumerate(zip(df.columns, df.schema.fields))])
    distinct = value_groups(df, df.columns).groupBy("k").agg(F.count(F.lit(1)).alias("n_unique"))
    return (rows.join(distinct, rows["column"] == distinct["k"], "left")
            .select("position", "column", "type", "non_null", "missing_pct",
                    F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique")))


def overview(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns, % missing cells (1 decimal), duplicate rows, positive rate (valid rule)."""
    n_cols = len(df.columns)
    t = _c(target).cast("double")
    miss = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  sum((F.count_if(_c(c).isNull()) for c in df.columns), F.lit(0)).alias("_cells_missing"),
                  F.coalesce(F.try_divide(F.count_if(t == 1) * 100.0, F.count(t)), F.lit(0.0)).alias("_rate"))
    return (miss.crossJoin(duplicate_count(df))
            .select("n_rows", F.lit(n_cols).alias("n_cols"),
                    F.round(F.coalesce(F.try_divide(F.col("_cells_missing") * 100.0,
                                                    F.col("n_rows") * n_cols), F.lit(0.0)), 1)
                    .alias("missing_cells_pct"),
                    "duplicate_rows", F.round("_rate", 1).alias("positive_rate")))


def class_imbalance(df: DataFrame, target: str, threshold: float = 10.0) -> DataFrame:
    rate = positive_rate(df, target, "valid")
    return rate.select("positive_rate", (F.col("positive_rate") < threshold).alias("imbalanced"))


# Issue kinds in the order the dashboard lists them (tie order).
ISSUE_KINDS = ["missing_values", "duplicates", "target_missing", "target_unexpected",
               "class_imbalance", "outliers"]


def issues(df: DataFrame, target: str, top: int = 5) -> DataFrame:
    """Ranked data-quality issues: (rank, kind, severity, column, n).
    Severity: worst missing %, duplicate %, missing-target %, 90 for
    unexpected target values, 80 for imbalance (< 10 %), the worst outlier
    count (>= 10 values, target included). Ties keep the list order.
    ``df`` has the target as read: text that is no number is a stray value
    there, not a missing one. The outlier issue names the three worst columns.
    Three scans: one aggregate (missing counts, target checks, outlier
    moments), the outlier counts against the broadcast moments, and the
    duplicate group count."""
    from pyspark.sql import Window
    cols = df.columns
    n_cols = len(cols)
    num = numeric_columns(df)
    t = as_number(_c(target), df.schema[target].dataType)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(_c(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(_c(target).isNull()).alias("_tnan"),
             F.coalesce(F.try_divide(F.count_if(t == 1) * 100.0, F.count(t)), F.lit(0.0)).alias("_rate"),
             F.count_distinct(F.when(~t.isin(0.0, 1.0), t)).alias("_unexp")]
    for i, c in enumerate(num):
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.count(x).alias(f"cnt{i}")]
    one = df.agg(*aggs)
    if num:
        moments = one.select(*[F.col(f"{p}{i}") for i in range(len(num)) for p in ("mean", "std")])
        joined = df.select(*[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(num)]) \
            .crossJoin(F.broadcast(moments))
        counted = joined.agg(*[F.count_if((F.col(f"std{i}") > 0) &
                                          (F.abs(F.col(f"x{i}") - F.col(f"mean{i}")) > 3 * F.col(f"std{i}")))
                               .alias(f"o{i}") for i in range(len(num))])
        per = one.crossJoin(counted).select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.col(f"o{i}").alias("o"),
                     F.col(f"cnt{i}").alias("cnt")) for i, c in enumerate(num)])).alias("e")).select("e.*") \
            .filter("o > 0 AND cnt >= 10")
        w = Window.partitionBy().orderBy(F.desc("o"), F.asc("pos"))
        worst3 = per.select("col", "o", F.row_number().over(w).alias("r")).filter("r <= 3")
        outl = worst3.agg(F.max("o").alias("_on"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("r", "col"))), lambda x: x["col"]), ", ").alias("_ocol")).filter("_on is not null")
    else:
        outl = df.sparkSession.createDataFrame([], "_ocol string, _on bigint")
    worst = F.greatest(*[F.col(f"m{i}") for i in range(n_cols)]) if n_cols > 1 else F.col("m0")
    # worst column: first column holding the maximum missing count
    worst_col = F.coalesce(*[F.when(F.col(f"m{i}") == worst, F.lit(c)) for i, c in enumerate(cols)])
    n_with = sum((F.when(F.col(f"m{i}") > 0, 1).otherwise(0) for i in range(n_cols)), F.lit(0))
    base = one.crossJoin(duplicate_count(df)).join(outl, how="left")
    n = F.col("_n")
    pct = lambda x: F.coalesce(F.try_divide(x * 100.0, n), F.lit(0.0))
    cand = [
        (F.lit(0), "missing_values", pct(worst).cast("double"), worst_col, n_with.cast("bigint"),
         worst > 0),
        (F.lit(1), "duplicates", pct(F.col("duplicate_rows")), F.lit(None), F.col("duplicate_rows"),
         F.col("duplicate_rows") > 0),
        (F.lit(2), "target_missing", pct(F.col("_tnan")), F.lit(target), F.col("_tnan"),
         F.col("_tnan") > 0),
        (F.lit(3), "target_unexpected", F.lit(90.0), F.lit(target), F.col("_unexp"),
         F.col("_unexp") > 0),
        (F.lit(4), "class_imbalance", F.lit(80.0), F.lit(target), F.lit(None).cast("bigint"),
         F.col("_rate") < 10),
        (F.lit(5), "outliers", F.col("_on").cast("double"), F.col("_ocol"), F.col("_on"),
         F.col("_on").isNotNull()),
    ]
    entries = [F.struct(o.alias("_order"), F.lit(kind).alias("kind"), F.round(sev, 6).alias("severity"),
                        col.cast("string").alias("column"), cnt.cast("bigint").alias("n"),
                        present.alias("_present"))
               for o, kind, sev, col, cnt, present in cand]
    rows = _rows(base, entries).filter("_present")
    w = Window.partitionBy().orderBy(F.desc("severity"), F.asc("_order"))
    return (rows.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= top)
            .select(F.col("rank").cast("int"), "kind", "severity", "column", "n"))


# ---- distributions ------------------------------------------------------------------

def histograms(df: DataFrame, cols: list[str] | None = None, bins: int = 30,
               target: str | None = None) -> DataFrame:
    """Equal-width histograms (numpy edges; the maximum falls in the last
    bin; a constant column spans [v - 0.5, v + 0.5]); empty bins included.
    (column, bin, lo, hi, n), for every numeric column unless ``cols`` says
    which. Bins are counted with one explode of a row's values into
    (column, bin) and a partial + final group count."""
    cols = cols or numeric_columns(df, target)
    mm = df.agg(*[F.min(_c(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                *[F.max(_c(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)])
    lo = [F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}") - 0.5).otherwise(F.col(f"a{i}"))
          for i in range(len(cols))]
    hi = [F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"b{i}") + 0.5).otherwise(F.col(f"b{i}"))
          for i in range(len(cols))]
    edges = mm.select(*[x.alias(f"lo{i}") for i, x in enumerate(lo)],
                      *[x.alias(f"hi{i}") for i, x in enumerate(hi)])
    data = df.select(*[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]) \
        .crossJoin(F.broadcast(edges))
    hits = []
    for i in range(len(cols)):
        x, a, b = F.col(f"x{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        k = F.least(F.floor((x - a) * bins / (b - a)), F.lit(bins - 1)).cast("int")
        hits.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), k.alias("bin"))))
    counted = (data.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
               .groupBy(F.col("h.i").alias("i"), F.col("h.bin").alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    grid = edges.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"lo{i}").alias("a"),
                 F.col(f"hi{i}").alias("b")) for i, c in enumerate(cols)])).alias("g")) \
        .select("g.*").filter("a IS NOT NULL") \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return (grid.join(counted, ["i", "bin"], "left")
            .select("column", "bin", _r6(F.col("a") + F.col("bin") * width).alias("lo"),
                    _r6(F.col("a") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (diagonal included) over
    pairwise-complete rows; NULL for a constant column. k(k+1)/2 guarded
    aggregates in one pass, then mirrored."""
    cols = cols or numeric_columns(df)
    aggs, entries = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            aggs.append(safe_corr(_c(a), _c(cols[j])).alias(f"r{i}_{j}"))
    one = df.agg(*aggs)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            src = f"r{min(i, j)}_{max(i, j)}"
            entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _r6(F.col(src)).alias("r")))
    return _rows(one, entries)


#: Up to so many groups, quartiles are searched on brackets without a shuffle;
#: more are ranked as a table.
GROUPS_AT_ONCE = 32


def _quartiles(df: DataFrame, cols: list[str], g: Column) -> tuple[DataFrame, bool]:
    """g, column, q1, med, q3 of every numeric column in every group, and
    whether the groups are few."""
    few = df.select(g.alias("g")).filter("g IS NOT NULL").distinct().limit(GROUPS_AT_ONCE + 1).collect()
    qs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    if len(few) > GROUPS_AT_ONCE:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), _c(c).cast("double").alias("x")) for i, c in enumerate(cols)])
        long = df.filter(g.isNotNull()).select(g.alias("g"), F.explode(cells).alias("e")).select("g", "e.i", "e.x")
        names = F.array(*map(F.lit, cols))
        return group_quantiles(long, ["g", "i"], "x", qs).select("g", F.element_at(names, F.col("i") + 1).alias("column"), *qs), False
    groups = sorted(r["g"] for r in few)
    series = [(_c(c), g == F.lit(v)) for v in groups for c in cols]
    found = quantiles(df, series, [list(qs.values())] * len(series)) if series else []
    rows = [(v, c, *q) for (v, c), q in zip([(v, c) for v in groups for c in cols], found)]
    return df.sparkSession.createDataFrame(rows, "g double, column string, q1 double, med double, q3 double"), True


def box_stats(df: DataFrame, cols: list[str] | None = None, by: str = "is_fraud") -> DataFrame:
    """Box-plot numbers per group value: exact quartiles, whiskers at the
    furthest values within 1.5 IQR, flier count, for every numeric column
    unless ``cols`` says which. The second pass joins the per-group table of
    quartiles and aggregates."""
    cols = cols or numeric_columns(df, by)
    g = _c(by).cast("double")
    qdf, few = _quartiles(df, cols, g)
    wide = qdf.groupBy("g").pivot("column", cols).agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3")).withColumnRenamed("g", "_g")
    joined = join_groups(df.select(g.alias("g"), *[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]),
                         F.col("g"), wide, "_g", few, "inner")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"x{i}")
        q1, q3 = F.col(f"`{c}_q1`"), F.col(f"`{c}_q3`")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs += [F.min(F.when(x >= lo, x)).alias(f"wl{i}"), F.max(F.when(x <= hi, x)).alias(f"wh{i}"),
                 F.count_if((x < lo) | (x > hi)).alias(f"fl{i}")]
    second = joined.groupBy("g").agg(*aggs)
    entries = [F.struct(F.lit(i).alias("_i"), F.lit(c).alias("column"), F.col(f"wl{i}").alias("whisker_lo"),
                        F.col(f"wh{i}").alias("whisker_hi"), F.col(f"fl{i}").alias("n_fliers"))
               for i, c in enumerate(cols)]
    long = second.select("g", F.explode(F.array(*entries)).alias("e")).select("g", "e.*")
    return (long.join(qdf, ["g", "column"])
            .select(F.col("g").alias(by), "column", _r6(F.col("q1")).alias("q1"),
                    _r6(F.col("med")).alias("median"), _r6(F.col("q3")).alias("q3"),
                    "whisker_lo", "whisker_hi", "n_fliers"))


# ---- free-text context -------------------------------------------------------------------

def data_summary(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Schema + describe(include="all") + first ``n`` rows by ``key`` as one
    long string table (section, name, attribute, value)."""
    schema = df.sparkSession.createDataFrame(
        [("schema", f.name, "type", f.dataType.simpleString()) for f in df.schema.fields],
        "section string, name string, attribute string, value string")
    d = describe(df, include="all")
    stat_cols = [c for c in d.columns if c != "column"]
    stats = d.select(F.lit("statistics").alias("section"), F.col("column").alias("name"),
                     F.explode(F.array(*[F.struct(F.lit(s).alias("attribute"),
                                                  F.col(s).cast("string").alias("value"))
                                         for s in stat_cols])).alias("kv")) \
        .select("section", "name", "kv.attribute", "kv.value").filter("value IS NOT NULL")
    from pyspark.sql import Window
    head = df.orderBy(_c(key)).limit(n)
    head = head.select("*", F.row_number().over(Window.orderBy(_c(key))).alias("_row"))
    sample = head.select(F.lit("sample").alias("section"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.concat(F.lit("row "), (F.col("_row") - 1).cast("string"))
                 .alias("attribute"), _c(c).cast("string").alias("value")) for c in df.columns])).alias("kv")) \
        .select("section", "kv.name", "kv.attribute", "kv.value")
    return schema.unionByName(stats).unionByName(sample)
