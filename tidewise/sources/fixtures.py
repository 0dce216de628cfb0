"""Derived input views over the test tables (FIXTURES.md section B).

``raw`` (dirty transactions, all STRING, as a CSV read gives them),
``history`` (a round for every event) and ``responses``
(recommendation texts). Spark builds them with the DataFrame API; the SQL
text of each view is kept verbatim for the DuckDB oracle, which embeds it
as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewise.operators.windows import trailing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# The outer projection of the raw view, as SQL expressions over events +
# the two trailing-window columns n_24h and avg_7d.
_RAW_SELECT = [
    "concat('T', cast(event_id AS string)) AS transaction_id",
    "concat('U', cast(user_id AS string)) AS user_id",
    "CASE WHEN event_id % 211 = 7 THEN 'not a date' ELSE cast(ts AS string) END AS timestamp",
    "cast(date '2023-11-20' + cast(user_id % 60 AS int) AS string) AS user_signup_date",
    "CASE WHEN event_id % 101 = 10 THEN 'bad_value' WHEN event_id % 17 = 2 THEN NULL ELSE cast(value AS string) END AS amount",
    "CASE WHEN event_id % 53 = 1 THEN '0' WHEN event_id % 19 = 5 THEN NULL ELSE cast(round(avg_7d, 6) AS string) END AS avg_amount_7d",
    "cast(n_24h AS string) AS prior_transactions_24h",
    "CASE WHEN event_id % 7 = 0 THEN '1' ELSE '0' END AS is_international",
    "CASE WHEN event_id % 23 = 5 THEN NULL WHEN event_id % 29 = 6 THEN 'N/A' WHEN event_id % 5 = 0 THEN concat(' ', upper(event_type), ' ') ELSE event_type END AS merchant_category",
    "CASE WHEN event_id % 31 = 8 THEN 'none' WHEN event_id % 4 = 0 THEN 'Online' WHEN event_id % 4 = 1 THEN 'pos' ELSE 'transfer' END AS transaction_type",
    "CASE WHEN event_id % 37 = 9 THEN '' WHEN user_id % 3 = 0 THEN 'Mobile' WHEN user_id % 3 = 1 THEN 'desktop' ELSE 'tablet' END AS device_type",
    "CASE WHEN event_id % 97 = 3 THEN '2.0' WHEN event_id % 89 = 4 THEN NULL WHEN value > 120 OR event_id % 23 = 0 THEN '1' ELSE '0' END AS is_fraud",
]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    e = trailing(ev, "user_id", "ts", {
        "n_24h": (1, None),
        "avg_7d": (7, "value"),
    })
    return e.selectExpr(*_RAW_SELECT)


_HISTORY_SELECT = [
    "run_id", "iteration", "model_name",
    "concat('Model: ', model_name, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 = 1 THEN concat('(n_estimators=', cast(50 + event_id % 250 AS string), ', max_depth=', cast(5 + event_id % 25 AS string), ')') ELSE '(C=1.0)' END, chr(10), 'Train size: 400, Test size: 100') AS model_report",
    "concat(CASE WHEN run_id % 4 = 0 OR iteration = 0 THEN 'Using default feature set (no LLM recommendations yet)' ELSE 'Using LLM-recommended features (3)' END, chr(10), 'Created: account_age_days = (timestamp - signup_date).days', chr(10), 'Created: hour_of_day = timestamp.hour', CASE WHEN event_id % 2 = 0 THEN concat(chr(10), 'Created: log_amount = log1p(amount)') ELSE '' END, CASE WHEN event_id % 3 = 0 THEN concat(chr(10), 'Skipped unknown feature: bogus') ELSE '' END, chr(10), 'One-hot encoded: device_type') AS feature_report",
    "tp", "fp", "fn", "tn",
    "round(CAST(tp + tn AS double) / (tp + fp + fn + tn), 4) AS accuracy",
    "CASE WHEN event_id % 41 = 3 THEN NULL WHEN tp + fp = 0 THEN 0.0 ELSE round(CAST(tp AS double) / (tp + fp), 4) END AS prec",
    "CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(CAST(tp AS double) / (tp + fn), 4) END AS recall",
    "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(CAST(2 * tp AS double) / (2 * tp + fp + fn), 4) END AS f1",
    "event_id % 9 = 4 AS should_stop",
]


_ROUND_SELECT = [
    "event_id", "event_id div 6 AS run_id",
    "CAST(event_id % 6 + CASE WHEN event_id % 6 >= 3 AND event_id div 6 % 5 = 2 THEN 1 ELSE 0 END AS int) AS iteration",
    "CASE WHEN event_id % 4 = 0 THEN 'LogisticRegression' WHEN event_id % 4 = 1 THEN 'RandomForestClassifier' WHEN event_id % 4 = 2 THEN 'GradientBoostingClassifier' ELSE 'SVC' END AS model_name",
    "(event_id % 7) * 5 AS tp", "event_id % 11 AS fp", "event_id % 13 AS fn", "400 + event_id % 50 AS tn",
]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a round: run ``event_id div 6``, six rounds each, with a
    gap in the numbering of every fifth run. A projection, no shuffle."""
    return events(spark, sf_dir).selectExpr(*_ROUND_SELECT).selectExpr(*_HISTORY_SELECT)


_RESPONSES_SELECT = [
    "event_id AS response_id",
    """CASE event_id % 7
         WHEN 0 THEN concat('{"features_to_add": ["log_amount", "moon_phase", "is_weekend"], "model_config": {"model_name": "RandomForestClassifier", "hyperparameters": {"n_estimators": ', cast(event_id % 600 AS string), ', "max_depth": 12.7}}, "should_stop": false, "reasoning": "r', cast(event_id AS string), '"}')
         WHEN 1 THEN concat('```json', chr(10), '{"features_to_add": ["amount_squared"], "model_config": {"model_name": "SVC", "hyperparameters": {"C": ', cast(event_id % 40 AS string), ', "kernel": "poly"}}, "should_stop": true}', chr(10), '```')
         WHEN 2 THEN 'I would add more features.'
         WHEN 3 THEN '{"features_to_add": ["tide_level"], "model_config": {"model_name": "OracleForest", "hyperparameters": {"C": 3}}, "should_stop": "yes"}'
         WHEN 4 THEN '  {"features_to_add": "log_amount", "model_config": {"model_name": "GradientBoostingClassifier", "hyperparameters": {"learning_rate": 9, "max_depth": null}}}  '
         WHEN 5 THEN '{"features_to_add": [], "model_config": {"model_name": "LogisticRegression", "hyperparameters": {"C": "5"}}, "should_stop": true}'
         ELSE '{}' END AS response_text""",
]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_RESPONSES_SELECT)


# ---------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracle (FIXTURES.md section B).
# ---------------------------------------------------------------------------

RAW_SQL = """SELECT concat('T', cast(event_id AS string)) AS transaction_id,
       concat('U', cast(user_id AS string)) AS user_id,
       CASE WHEN event_id % 211 = 7 THEN 'not a date' ELSE cast(ts AS string) END AS timestamp,
       cast(date '2023-11-20' + cast(user_id % 60 AS int) AS string) AS user_signup_date,
       CASE WHEN event_id % 101 = 10 THEN 'bad_value' WHEN event_id % 17 = 2 THEN NULL ELSE cast(value AS string) END AS amount,
       CASE WHEN event_id % 53 = 1 THEN '0' WHEN event_id % 19 = 5 THEN NULL ELSE cast(round(avg_7d, 6) AS string) END AS avg_amount_7d,
       cast(n_24h AS string) AS prior_transactions_24h,
       CASE WHEN event_id % 7 = 0 THEN '1' ELSE '0' END AS is_international,
       CASE WHEN event_id % 23 = 5 THEN NULL WHEN event_id % 29 = 6 THEN 'N/A' WHEN event_id % 5 = 0 THEN concat(' ', upper(event_type), ' ') ELSE event_type END AS merchant_category,
       CASE WHEN event_id % 31 = 8 THEN 'none' WHEN event_id % 4 = 0 THEN 'Online' WHEN event_id % 4 = 1 THEN 'pos' ELSE 'transfer' END AS transaction_type,
       CASE WHEN event_id % 37 = 9 THEN '' WHEN user_id % 3 = 0 THEN 'Mobile' WHEN user_id % 3 = 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
       CASE WHEN event_id % 97 = 3 THEN '2.0' WHEN event_id % 89 = 4 THEN NULL
            WHEN value > 120 OR event_id % 23 = 0 THEN '1' ELSE '0' END AS is_fraud
FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) - 1 AS n_24h,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS avg_7d
      FROM events) e"""

HISTORY_SQL = """SELECT run_id, iteration, model_name,
       concat('Model: ', model_name, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 = 1 THEN concat('(n_estimators=', cast(50 + event_id % 250 AS string), ', max_depth=', cast(5 + event_id % 25 AS string), ')') ELSE '(C=1.0)' END,
              chr(10), 'Train size: 400, Test size: 100') AS model_report,
       concat(CASE WHEN run_id % 4 = 0 OR iteration = 0 THEN 'Using default feature set (no LLM recommendations yet)' ELSE 'Using LLM-recommended features (3)' END, chr(10),
              'Created: account_age_days = (timestamp - signup_date).days', chr(10), 'Created: hour_of_day = timestamp.hour',
              CASE WHEN event_id % 2 = 0 THEN concat(chr(10), 'Created: log_amount = log1p(amount)') ELSE '' END,
              CASE WHEN event_id % 3 = 0 THEN concat(chr(10), 'Skipped unknown feature: bogus') ELSE '' END, chr(10), 'One-hot encoded: device_type') AS feature_report,
       tp, fp, fn, tn, round(CAST(tp + tn AS double) / (tp + fp + fn + tn), 4) AS accuracy,
       CASE WHEN event_id % 41 = 3 THEN NULL WHEN tp + fp = 0 THEN 0.0 ELSE round(CAST(tp AS double) / (tp + fp), 4) END AS prec,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(CAST(tp AS double) / (tp + fn), 4) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(CAST(2 * tp AS double) / (2 * tp + fp + fn), 4) END AS f1,
       event_id % 9 = 4 AS should_stop
FROM (SELECT event_id, event_id // 6 AS run_id,
             event_id % 6 + CASE WHEN event_id % 6 >= 3 AND event_id // 6 % 5 = 2 THEN 1 ELSE 0 END AS iteration,
             CASE WHEN event_id % 4 = 0 THEN 'LogisticRegression' WHEN event_id % 4 = 1 THEN 'RandomForestClassifier' WHEN event_id % 4 = 2 THEN 'GradientBoostingClassifier' ELSE 'SVC' END AS model_name,
             (event_id % 7) * 5 AS tp, event_id % 11 AS fp, event_id % 13 AS fn, 400 + event_id % 50 AS tn
      FROM events) e"""

RESPONSES_SQL = "SELECT " + ",\n       ".join(_RESPONSES_SELECT) + "\nFROM events"
