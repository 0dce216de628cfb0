"""Feature registry, one-hot encoding and the modelling table.

Each registry entry is a named column-expression builder with the source
columns it needs and the features it depends on. A requested feature whose
sources are absent is skipped and reported, never an error. Only
``is_high_amount`` needs a fitted value (the exact 95th percentile of
``amount``); everything else is row-local, so ``FeatureModel.transform`` is
one projection per dependency level.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.expressions import flag
from tidewise.functions.quantiles import quantile
from tidewise.roles import Roles
from tidewise.session import discard, materialize

_DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Feature:
    name: str
    sources: tuple[str, ...]
    build: Callable[[dict], Column]
    deps: tuple[str, ...] = ()
    description: str = ""
    fitted: bool = False


def _c(name: str) -> Column:
    return F.col(name)


def _age(_):
    diff = F.timestamp_diff("MICROSECOND", _c("user_signup_date").cast("timestamp_ntz"),
                            _c("timestamp").cast("timestamp_ntz"))
    return F.floor(diff / F.lit(_DAY_US)).cast("bigint")


REGISTRY: dict[str, Feature] = {}


def register(f: Feature) -> Feature:
    """Add (or replace) a registry entry; users may register their own."""
    REGISTRY[f.name] = f
    return f


for _f in [
    Feature("account_age_days", ("timestamp", "user_signup_date"), _age,
            description="account_age_days = (timestamp - signup_date).days"),
    Feature("hour_of_day", ("timestamp",), lambda _: F.hour(_c("timestamp")),
            description="hour_of_day = timestamp.hour"),
    Feature("day_of_week", ("timestamp",), lambda _: F.weekday(_c("timestamp")),
            description="day_of_week = timestamp.dayofweek"),
    Feature("amount_to_avg_ratio", ("amount", "avg_amount_7d"),
            lambda _: F.coalesce(F.try_divide(_c("amount").cast("double"), _c("avg_amount_7d")),
                                 F.lit(1.0)),
            description="amount_to_avg_ratio = amount / avg_amount_7d"),
    Feature("is_high_amount", ("amount",),
            lambda fit: flag(_c("amount") > F.lit(fit["amount_q95"])) if fit.get("amount_q95")
            is not None else F.lit(0),
            description="is_high_amount = (amount > q95)", fitted=True),
    Feature("log_amount", ("amount",),
            lambda _: F.log1p(F.when(_c("amount").isNotNull(), F.greatest(_c("amount"), F.lit(0.0)))),
            description="log_amount = log1p(amount)"),
    Feature("is_new_account", (), lambda _: flag(_c("account_age_days") < 30),
            deps=("account_age_days",), description="is_new_account = (account_age_days < 30)"),
    Feature("is_night_txn", (),
            lambda _: flag((_c("hour_of_day") >= 23) | (_c("hour_of_day") <= 5)),
            deps=("hour_of_day",), description="is_night_txn = (hour >= 23 or hour <= 5)"),
    Feature("amount_deviation", ("amount", "avg_amount_7d"),
            lambda _: F.abs(_c("amount") - _c("avg_amount_7d")),
            description="amount_deviation = |amount - avg_amount_7d|"),
    Feature("high_velocity", ("prior_transactions_24h",),
            lambda _: flag(_c("prior_transactions_24h") >= 4),
            description="high_velocity = (prior_transactions_24h >= 4)"),
    Feature("amount_squared", ("amount",), lambda _: _c("amount") * _c("amount"),
            description="amount_squared = amount^2"),
    Feature("amount_x_velocity", ("amount", "prior_transactions_24h"),
            lambda _: _c("amount") * _c("prior_transactions_24h"),
            description="amount_x_velocity = amount * prior_transactions_24h"),
    Feature("is_weekend", (), lambda _: flag(_c("day_of_week") >= 5),
            deps=("day_of_week",), description="is_weekend = (day_of_week >= 5)"),
    Feature("txn_per_avg_ratio", ("prior_transactions_24h", "avg_amount_7d"),
            lambda _: F.coalesce(F.try_divide(_c("prior_transactions_24h").cast("double"),
                                              _c("avg_amount_7d")), F.lit(0.0)),
            description="txn_per_avg_ratio = prior_transactions_24h / avg_amount_7d"),
]:
    register(_f)

# The default features of the first round, in order.
DEFAULT_FEATURES = ["account_age_days", "hour_of_day", "day_of_week",
                    "amount_to_avg_ratio", "is_high_amount"]


def _available(name: str, cols: set[str]) -> bool:
    f = REGISTRY[name]
    if name in cols:
        return True
    return all(s in cols for s in f.sources) and all(_available(d, cols) for d in f.deps)


@dataclass
class FeatureModel:
    plan: list[list[str]]           # names per dependency level
    created: list[str]              # requested features built, in order
    skipped: list[tuple[str, str]]  # (name, reason)
    source: str                     # "default" or "recommended"
    fitted: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [n for level in self.plan for n in level]

    def transform(self, df: DataFrame) -> DataFrame:
        for level in self.plan:
            df = df.withColumns({n: REGISTRY[n].build(self.fitted) for n in level})
        return df

    def report(self, spark) -> DataFrame:
        rows = [(i, n, "created", REGISTRY[n].description, self.source)
                for i, n in enumerate(self.created)]
        rows += [(len(self.created) + i, n, "skipped", why, self.source)
                 for i, (n, why) in enumerate(self.skipped)]
        return spark.createDataFrame(
            rows, "position int, feature string, status string, detail string, source string")


class FeatureSet:
    """Apply requested registry features in order (defaults if none), with
    dependencies first and no repeats."""

    def __init__(self, names: list[str] | None = None, roles: Roles | None = None):
        self.source = "recommended" if names else "default"
        self.names = list(names) if names else list(DEFAULT_FEATURES)
        self.roles = roles or Roles()

    def fit(self, df: DataFrame) -> FeatureModel:
        cols = set(df.columns)
        order: list[str] = []
        created, skipped = [], []

        def add(n):
            if n in order or n in cols:
                return
            for d in REGISTRY[n].deps:
                add(d)
            order.append(n)

        for n in self.names:
            if n not in REGISTRY:
                skipped.append((n, "unknown feature"))
            elif not _available(n, cols):
                skipped.append((n, "source columns absent"))
            elif n not in created:
                add(n)
                created.append(n)
        # dependency levels: a feature goes one level above its deepest dependency
        level: dict[str, int] = {}
        for n in order:
            level[n] = 1 + max((level.get(d, -1) for d in REGISTRY[n].deps), default=-1)
        plan = [[n for n in order if level[n] == k] for k in range(max(level.values(), default=-1) + 1)]
        fitted = {}
        if "is_high_amount" in order:
            fitted["amount_q95"] = quantile(df, "amount", 0.95)
        return FeatureModel(plan, created, skipped, self.source, fitted)


def category_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-missing (k = column, v = value as text) pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    return df.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL").distinct()


def one_hot_fit(df: DataFrame, cols: list[str], max_categories: int = 10_000) -> dict[str, list[str]] | None:
    """Sorted distinct non-missing values per column, from one distributed
    distinct over (column, value) pairs; None where there are more than
    ``max_categories`` in all, which is checked before anything is collected."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    rows = category_pairs(df, cols).limit(max_categories + 1).collect()  # one job, bounded
    if len(rows) > max_categories:
        return None
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        found[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in found.items()}


@dataclass
class OneHotModel:
    categories: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        """0/1 column per value, alphabetically first dropped, missing -> all zero."""
        out = {}
        for c, vals in self.categories.items():
            for v in vals[1:]:
                out[f"{c}_{v}"] = flag(F.col(c) == F.lit(v))
        return df.withColumns(out) if out else df


#: Copies of each dictionary entry that rows are joined with, so that a value
#: of a third of the rows is spread over so many tasks.
SALTS = 16


@dataclass
class WideOneHotModel:
    """Categories as a table instead of columns: ``dictionary`` (k, v, i) gives
    the place i of value v in the vector of column k, the alphabetically first
    value of a column having none; ``sizes`` the length of each vector."""
    dictionary: DataFrame
    sizes: dict[str, int]
    out: str = "onehot"

    @property
    def categories(self) -> dict[str, int]:
        return self.sizes

    @property
    def columns(self) -> list[str]:
        return [self.out]

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with the place of each column's value, the vector's length
        where it has none (missing, first or never seen), as ``_i0``, ``_i1``..."""
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
        names = list(df.columns)
        df = df.withColumn("_salt", salt)
        for j, (c, n) in enumerate(self.sizes.items()):
            places = (self.dictionary.filter(F.col("k") == c)
                      .select(F.col("v").alias("_v"), F.col("i").cast("double").alias("_at"),
                              F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_s")))
            df = (df.join(places, (F.col(f"`{c}`").cast("string") == F.col("_v")) & (F.col("_salt") == F.col("_s")), "left")
                  .select(*[F.col(f"`{x}`") for x in names], "_salt", *[f"_i{k}" for k in range(j)],
                          F.coalesce("_at", F.lit(float(n)))
                          .alias(f"_i{j}", metadata={"ml_attr": {"type": "nominal", "num_vals": max(n, 1)}})))
        return df.drop("_salt")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the sparse vector ``out``: the columns' 0/1 vectors side by side."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler

        at = [f"_i{j}" for j in range(len(self.sizes))]
        vectors = [f"_x{j}" for j in range(len(self.sizes))]
        known = self.indexed(df)
        encoder = OneHotEncoder(inputCols=at, outputCols=vectors, handleInvalid="keep").fit(known)
        joined = VectorAssembler(inputCols=vectors, outputCol=self.out).transform(encoder.transform(known))
        return joined.drop(*at, *vectors)


def wide_one_hot_fit(df: DataFrame, cols: list[str]) -> WideOneHotModel:
    """A dictionary of any number of categories: the distinct values are dealt
    out by ranges, numbered within their range and moved by the sizes of the
    ranges before, so no list of values reaches the driver or one task."""
    cols = [c for c in cols if c in df.columns]
    ranged = materialize(category_pairs(df, cols).repartitionByRange("k", "v")
                         .withColumn("_p", F.spark_partition_id()), "categories")
    held = ranged.groupBy("k", "_p").agg(F.count(F.lit(1)).alias("n"))
    # a row for each range and column
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("k", "_p").orderBy("v"))
    numbered = (ranged.join(held.select("k", "_p", before.alias("_before")), ["k", "_p"])
                .select("k", "v", (F.col("_before") + place - 2).alias("i")).filter("i >= 0"))
    dictionary = materialize(numbered, "dictionary")
    counts = {r["k"]: r["n"] for r in dictionary.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    discard(ranged)
    return WideOneHotModel(dictionary, {c: counts.get(c, 0) for c in cols})


class OneHot:
    """0/1 columns for up to ``max_categories`` values in all columns together,
    one sparse vector column beyond."""

    def __init__(self, cols: list[str], max_categories: int = 10_000):
        self.cols, self.max_categories = cols, max_categories

    def fit(self, df: DataFrame) -> OneHotModel | WideOneHotModel:
        few = one_hot_fit(df, self.cols, self.max_categories)
        return OneHotModel(few) if few is not None else wide_one_hot_fit(df, self.cols)


def drop_roles(df: DataFrame, roles: Roles | None = None, keep: list[str] | None = None) -> DataFrame:
    roles = roles or Roles()
    keep = set(keep or [])
    return df.drop(*[c for c in roles.drop_cols if c in df.columns and c not in keep])


@dataclass
class FeatureTableModel:
    features: FeatureModel
    onehot: OneHotModel
    roles: Roles

    def transform(self, clean: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return drop_roles(self.onehot.transform(self.features.transform(clean)), self.roles, keep)


def fit_feature_table(clean: DataFrame, names: list[str] | None = None,
                      roles: Roles | None = None) -> FeatureTableModel:
    roles = roles or Roles()
    fm = FeatureSet(names, roles).fit(clean)
    oh = OneHot(roles.present(clean, "categorical")).fit(clean)
    return FeatureTableModel(fm, oh, roles)


def build_features(clean: DataFrame, names: list[str] | None = None,
                   roles: Roles | None = None, keep: list[str] | None = None) -> DataFrame:
    """clean -> selected features -> one-hot -> drop identifiers: the
    modelling table (``keep`` retains e.g. the row key)."""
    return fit_feature_table(clean, names, roles).transform(clean, keep)
