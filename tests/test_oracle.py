"""Spark result == DuckDB oracle at sf 0.001 for a cross-section of keys
(the full set runs with tools/check_oracle.py at sf 0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
KEYS = ["infer_types", "clean", "cleaning_report", "feature_table", "feat_account_age_days",
        "prior_transactions_24h", "describe_all", "missing_top5", "quality_issues", "histograms",
        "correlation_matrix", "boxplot_by_target", "category_cardinality", "data_summary",
        "classification_report", "validate_recommendations", "history_model_config", "diagnose",
        "stratified_split", "standard_scale", "linear_score"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows, 6)[0] == digest(d_cols, d_rows, 6)[0]
