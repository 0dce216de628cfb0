"""Column roles: which columns are target, numeric, categorical, timestamps,
identifiers and the row key. Steps look columns up by role and skip the
ones that are absent."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The column names the transaction pipeline expects by default.
STRING_COLS = ["merchant_category", "transaction_type", "device_type"]
NUMERIC_FILL_COLS = ["amount", "avg_amount_7d", "is_international", "prior_transactions_24h"]
TIMESTAMP_COLS = ["timestamp", "user_signup_date"]
ID_COLS = ["transaction_id", "user_id"]
DEFAULT_TARGET = "is_fraud"


@dataclass(frozen=True)
class Roles:
    target: str = DEFAULT_TARGET
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC_FILL_COLS))
    categorical: list[str] = field(default_factory=lambda: list(STRING_COLS))
    timestamps: list[str] = field(default_factory=lambda: list(TIMESTAMP_COLS))
    ids: list[str] = field(default_factory=lambda: list(ID_COLS))
    key: str = "transaction_id"

    def present(self, df: DataFrame, kind: str) -> list[str]:
        cols = set(df.columns)
        return [c for c in getattr(self, kind) if c in cols]

    @property
    def drop_cols(self) -> list[str]:
        """Columns removed before modelling: ids, timestamps, raw categoricals."""
        return list(self.ids) + list(self.timestamps) + list(self.categorical)

    @staticmethod
    def infer(df: DataFrame, target: str | None = None, key: str | None = None) -> "Roles":
        """Roles for an arbitrary table: target defaults to ``is_fraud`` if
        present, else the first column; numeric / string columns by type."""
        cols = df.columns
        tgt = target or (DEFAULT_TARGET if DEFAULT_TARGET in cols else cols[0])
        if key == tgt:
            raise ValueError(f"column {key} cannot be key and target")
        numeric, categorical, stamps = [], [], []
        for f in df.schema.fields:
            if f.name == tgt or f.name == key:
                continue
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                numeric.append(f.name)
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                stamps.append(f.name)
            elif isinstance(f.dataType, T.StringType):
                categorical.append(f.name)
        return Roles(target=tgt, numeric=numeric, categorical=categorical,
                     timestamps=stamps, ids=[key] if key else [],
                     key=key or next((c for c in cols if c != tgt), cols[0]))

    def with_target(self, target: str) -> "Roles":
        return replace(self, target=target)
