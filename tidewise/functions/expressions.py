"""Column-expression helpers shared by all steps. All are built-in Spark
expressions (JVM side, whole-stage codegen); no Python UDF anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens a default pandas CSV read treats as missing.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Text a string column treats as missing after strip + lower.
STRING_NA = ["nan", "n/a", "none", ""]

# The layouts pandas' numeric parser accepts (no 1d / 1f suffixes).
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
# The same without white space around, so that most cells need no stripping.
_PLAIN_NUMBER = NUMBER_PATTERN[:-1] + r"\z"

_WS = r"(?U)^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing white space of any kind (Spark ``trim`` only
    strips blanks)."""
    return F.regexp_replace(c, _WS, "")


def to_number(c: Column) -> Column:
    """Text -> DOUBLE the way ``pd.to_numeric(errors='coerce')`` does;
    anything that is not a plain decimal number becomes NULL."""
    text = c.cast("string")
    s = strip_ws(text)
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double")).when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def is_number_text(c: Column) -> Column:
    return strip_ws(c.cast("string")).rlike(NUMBER_PATTERN)


def is_integer_text(c: Column) -> Column:
    return strip_ws(c.cast("string")).rlike(INTEGER_PATTERN)


def as_number(c: Column, dtype) -> Column:
    """Numeric columns pass through (as DOUBLE), text goes through ``to_number``."""
    from pyspark.sql import types as T
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return to_number(c)


def normalise_text(c: Column, tokens=STRING_NA) -> Column:
    """strip + lower-case; listed tokens become NULL."""
    s = F.lower(strip_ws(c.cast("string")))
    return F.when(~s.isin(list(tokens)), s)


def flag(cond: Column) -> Column:
    """Boolean -> INT 0/1 with NULL counted as false (pandas ``astype(int)``
    of a comparison with NaN)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL when either side
    is constant (Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI)."""
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))
