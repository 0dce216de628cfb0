import os
import sys
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewise-test-", dir="/tmp"))
    yield s


@pytest.fixture
def dirty_rows():
    """20 dirty transactions, all text, as a CSV read gives them."""
    rng = np.random.default_rng(42)
    n = 20
    ts0, su0 = datetime(2024, 1, 1), datetime(2023, 5, 1)
    cats = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(n):
        amount = f"{rng.uniform(5, 500):.2f}"
        if i == 2:
            amount = None
        if i == 10:
            amount = "bad_value"
        avg = None if i == 5 else f"{rng.uniform(5, 500):.2f}"
        cat = cats[i % 4]
        mc = tt = dt = cat
        if i == 0:
            mc, tt, dt = f"  {cat.upper()}  ", f"  {cat.upper()}  ", f"  {cat.upper()}  "
        if i == 3:
            mc, tt, dt = cat.title(), cat.title(), cat.title()
        if i in (5, 12):
            mc = tt = dt = None
        target = str(i % 2)
        if i == 18:
            target = "2.0"
        if i == 19:
            target = None
        rows.append((f"transaction_id_{i:04d}", f"user_id_{i:04d}",
                     str(ts0 + timedelta(hours=i)), str((su0 + timedelta(days=7 * i)).date()),
                     amount, avg, f"{rng.uniform(5, 500):.2f}", f"{rng.uniform(5, 500):.2f}",
                     mc, tt, dt, target))
    return rows


DIRTY_SCHEMA = ("transaction_id string, user_id string, timestamp string, user_signup_date string, "
                "amount string, avg_amount_7d string, is_international string, prior_transactions_24h string, "
                "merchant_category string, transaction_type string, device_type string, is_fraud string")


@pytest.fixture
def dirty(spark, dirty_rows):
    return spark.createDataFrame(dirty_rows, DIRTY_SCHEMA)


@pytest.fixture
def feature_frame(spark):
    rows = [("2024-01-01 02:00:00", "2023-12-15", 100.0, 200.0, 0.0, 1.0, 0.0),
            ("2024-01-03 14:00:00", "2023-06-01", 500.0, 100.0, 1.0, 5.0, 1.0),
            ("2024-01-06 23:30:00", "2024-01-01", 50.0, 0.0, 0.0, 0.0, 0.0),
            ("2024-01-07 10:00:00", "2023-12-01", 2000.0, 500.0, 1.0, 4.0, 1.0),
            ("2024-01-08 05:00:00", "2023-11-01", 300.0, 300.0, 0.0, 2.0, 0.0),
            ("2024-01-10 18:00:00", "2023-10-01", 150.0, 250.0, 1.0, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "timestamp string, user_signup_date string, amount double, "
                                     "avg_amount_7d double, is_international double, "
                                     "prior_transactions_24h double, is_fraud double")
    return df.selectExpr("cast(timestamp as timestamp_ntz) timestamp",
                         "cast(user_signup_date as timestamp_ntz) user_signup_date",
                         "amount", "avg_amount_7d", "is_international", "prior_transactions_24h", "is_fraud")


@pytest.fixture
def history_frame(spark):
    rows = [("r", 0, "LogisticRegression", "Model: LogisticRegression(C=1.0)\nTrain size: 16, Test size: 4",
             "Using default feature set (no LLM recommendations yet)\nCreated: account_age_days = x\n"
             "Created: hour_of_day = x\nCreated: day_of_week = x\nCreated: amount_to_avg_ratio = x\n"
             "Created: is_high_amount = (amount > 1)", 0.75, 0.6, 0.75, 0.67, False),
            ("r", 1, "RandomForestClassifier", "Model: RandomForestClassifier(n_estimators=200)\nTrain size: 16",
             "Using LLM-recommended features (4)\nCreated: log_amount = x\nCreated: is_night_txn = x\n"
             "Created: high_velocity = x\nCreated: is_weekend = x", 0.85, 0.8, 0.85, 0.82, False)]
    return spark.createDataFrame(rows, "run_id string, iteration int, model_name string, model_report string, "
                                       "feature_report string, accuracy double, prec double, recall double, "
                                       "f1 double, should_stop boolean")
