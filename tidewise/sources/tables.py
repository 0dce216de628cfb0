"""Sources, typing and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.functions.expressions import (
    INTEGER_PATTERN, NUMBER_PATTERN, PANDAS_NA, strip_ws, to_number,
)


def na_to_null(df: DataFrame, tokens=PANDAS_NA, cols: list[str] | None = None) -> DataFrame:
    """Exact (unstripped) missing tokens -> NULL in string columns, as a
    default pandas CSV read does. Spark's single ``nullValue`` cannot
    express a list, so this is one projection of CASE expressions."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tokens = list(tokens)
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in cols})


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               na_values=PANDAS_NA, infer: bool = False, multi_line: bool = True) -> DataFrame:
    """Header CSV -> all-STRING table with missing tokens as NULL (optionally
    typed like a pandas read); Parquet / ORC / JSON are read natively. Quotes
    are doubled inside quoted fields. ``multi_line`` allows line breaks there,
    as pandas does; a file is then read by one task, so set it to False for
    large files whose fields have none."""
    if fmt == "csv":
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
              .option("nullValue", None).option("emptyValue", "").csv(path))
        df = na_to_null(df, na_values)
        return apply_types(df, infer_types(df)) if infer else df
    return spark.read.format(fmt).load(path)


def load_csv(df: DataFrame) -> DataFrame:
    """The missing-token step of a CSV read, for a table already read as text."""
    return na_to_null(df)


def infer_types(df: DataFrame) -> DataFrame:
    """Per column: the narrowest of bigint / double / string that every
    non-missing cell parses to, pandas-style: a column with a missing value
    cannot be bigint, an all-missing column is double. Non-string columns
    keep their type. One aggregate, then a projection of its single row.
    Output: (position, column, type, non_null)."""
    aggs, entries = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"nn{i}"))
        if isinstance(f.dataType, T.StringType):
            s, digit = strip_ws(c), c.rlike("[0-9]")  # no digit, no number: nothing to strip
            aggs.append(F.count_if(digit & s.rlike(INTEGER_PATTERN)).alias(f"ni{i}"))
            aggs.append(F.count_if(digit & s.rlike(NUMBER_PATTERN)).alias(f"nf{i}"))
    aggs.append(F.count(F.lit(1)).alias("_n"))
    one = df.agg(*aggs)
    for i, f in enumerate(df.schema.fields):
        nn = F.col(f"nn{i}")
        if isinstance(f.dataType, T.StringType):
            t = (F.when(nn == 0, F.lit("double"))
                 .when((F.col(f"ni{i}") == nn) & (nn == F.col("_n")), F.lit("bigint"))
                 .when(F.col(f"nf{i}") == nn, F.lit("double"))
                 .otherwise(F.lit("string")))
        else:
            t = F.lit(f.dataType.simpleString())
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                t.alias("type"), nn.alias("non_null")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def fit_types(df: DataFrame) -> dict[str, str]:
    """Collect the (one row per column) inference result."""
    return {r["column"]: r["type"] for r in infer_types(df).collect()}


def apply_types(df: DataFrame, types: DataFrame | dict[str, str]) -> DataFrame:
    if isinstance(types, DataFrame):
        types = {r["column"]: r["type"] for r in types.collect()}
    out = {}
    for f in df.schema.fields:
        t = types.get(f.name)
        if not isinstance(f.dataType, T.StringType) or t in (None, "string"):
            continue
        c = F.col(f"`{f.name}`")
        out[f.name] = strip_ws(c).try_cast("bigint") if t == "bigint" else to_number(c)
    return df.withColumns(out) if out else df


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 100, key: str = "transaction_id") -> DataFrame:
    """First ``n`` rows by ``key`` (a top-k, not a full sort)."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def coerce_target(df: DataFrame, target: str = "is_fraud") -> DataFrame:
    return df.withColumn(target, to_number(F.col(target))) if target in df.columns else df
