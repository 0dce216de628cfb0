"""DuckDB oracle SQL for every SQL-checkable registered query.

DuckDB pre-registers only the base tables, so each statement carries the
derived views it needs as CTEs. The building blocks below are plain SQL
text: the fixture views (verbatim from FIXTURES.md) and the cleaning /
feature semantics written out independently in SQL.
"""

from __future__ import annotations

from tidewise.sources.fixtures import HISTORY_SQL, RAW_SQL, RESPONSES_SQL

# Fixed values, written out here so that a wrong one in the library shows:
# what a CSV read takes as missing, and what counts as a number.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER_PATTERN = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
INTEGER_PATTERN = r"[+-]?\d+"

RAW_COLS = ["transaction_id", "user_id", "timestamp", "user_signup_date", "amount",
            "avg_amount_7d", "prior_transactions_24h", "is_international",
            "merchant_category", "transaction_type", "device_type", "is_fraud"]
NUMERIC = ["amount", "avg_amount_7d", "is_international", "prior_transactions_24h"]
STRINGS = ["merchant_category", "transaction_type", "device_type"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    """pandas to_numeric(errors='coerce') in SQL."""
    return (f"CASE WHEN regexp_full_match({strip(x)}, {q(NUMBER_PATTERN)}) "
            f"THEN TRY_CAST({strip(x)} AS DOUBLE) END")


def is_int(x: str) -> str:
    return f"regexp_full_match({strip(x)}, {q(INTEGER_PATTERN)})"


def is_num(x: str) -> str:
    return f"regexp_full_match({strip(x)}, {q(NUMBER_PATTERN)})"


def norm(x: str) -> str:
    return (f"CASE WHEN lower({strip(x)}) IN ('nan', 'n/a', 'none', '') THEN NULL "
            f"ELSE lower({strip(x)}) END")


NA_LIST = ", ".join(q(t) for t in PANDAS_NA)

LOADED = "SELECT " + ", ".join(
    f"CASE WHEN {c} IN ({NA_LIST}) THEN NULL ELSE {c} END AS {c}" for c in RAW_COLS) + " FROM raw"

# The inferred types of `loaded` (checked by the infer_types oracle):
# amount keeps text ('bad_value'), prior_transactions_24h / is_international
# are complete integers, avg_amount_7d and the target are doubles.
TYPED = ("SELECT transaction_id, user_id, timestamp, user_signup_date, amount, "
         f"{num('avg_amount_7d')} AS avg_amount_7d, "
         f"CAST({strip('prior_transactions_24h')} AS BIGINT) AS prior_transactions_24h, "
         f"CAST({strip('is_international')} AS BIGINT) AS is_international, "
         "merchant_category, transaction_type, device_type, "
         f"{num('is_fraud')} AS is_fraud FROM loaded")

COERCED = ("SELECT transaction_id, user_id, timestamp, user_signup_date, "
           + ", ".join(f"{num(c)} AS {c}" for c in NUMERIC) + ", "
           + ", ".join(f"{norm(c)} AS {c}" for c in STRINGS) + ", is_fraud FROM raw")

MEDIANS = "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC) + " FROM coerced"


def _mode(c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM coerced WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")


FILLED = ("SELECT coerced.transaction_id, coerced.user_id, coerced.timestamp, coerced.user_signup_date, "
          + ", ".join(f"coalesce(coerced.{c}, medians.{c}) AS {c}" for c in NUMERIC) + ", "
          + ", ".join(f"coalesce(coerced.{c}, {_mode(c)}) AS {c}" for c in STRINGS)
          + ", coerced.is_fraud FROM coerced, medians")

CLEAN = ("SELECT transaction_id, user_id, "
         f"TRY_CAST({strip('timestamp')} AS TIMESTAMP) AS timestamp, "
         f"TRY_CAST({strip('user_signup_date')} AS TIMESTAMP) AS user_signup_date, "
         + ", ".join(NUMERIC + STRINGS) + f", {num('is_fraud')} AS is_fraud "
         f"FROM filled WHERE {num('is_fraud')} IN (0.0, 1.0)")

# The category sets of the test data after normalisation.
CATEGORIES = {
    "merchant_category": ["click", "error", "purchase", "signup", "view"],
    "transaction_type": ["online", "pos", "transfer"],
    "device_type": ["desktop", "mobile", "tablet"],
}

FEATURE_SQL = {
    "account_age_days": "CAST(floor(date_diff('microsecond', user_signup_date, timestamp) / 86400000000.0) AS BIGINT)",
    "hour_of_day": "CAST(hour(timestamp) AS INTEGER)",
    "day_of_week": "CAST(isodow(timestamp) - 1 AS INTEGER)",
    "amount_to_avg_ratio": "CASE WHEN amount IS NULL OR avg_amount_7d IS NULL OR avg_amount_7d = 0 THEN 1.0 ELSE amount / avg_amount_7d END",
    "is_high_amount": "CAST(coalesce(amount > (SELECT quantile_cont(amount, 0.95) FROM clean), false) AS INTEGER)",
    "log_amount": "ln(1 + greatest(amount, 0.0))",
    "is_new_account": "CAST(coalesce(CAST(floor(date_diff('microsecond', user_signup_date, timestamp) / 86400000000.0) AS BIGINT) < 30, false) AS INTEGER)",
    "is_night_txn": "CAST(coalesce(hour(timestamp) >= 23 OR hour(timestamp) <= 5, false) AS INTEGER)",
    "amount_deviation": "abs(amount - avg_amount_7d)",
    "high_velocity": "CAST(coalesce(prior_transactions_24h >= 4, false) AS INTEGER)",
    "amount_squared": "amount * amount",
    "amount_x_velocity": "amount * prior_transactions_24h",
    "is_weekend": "CAST(coalesce(isodow(timestamp) - 1 >= 5, false) AS INTEGER)",
    "txn_per_avg_ratio": "CASE WHEN prior_transactions_24h IS NULL OR avg_amount_7d IS NULL OR avg_amount_7d = 0 THEN 0.0 ELSE prior_transactions_24h / avg_amount_7d END",
}
FEATURE_DEPS = {"is_new_account": ["account_age_days"], "is_night_txn": ["hour_of_day"],
                "is_weekend": ["day_of_week"]}


def onehot_sql() -> str:
    parts = []
    for c, vals in CATEGORIES.items():
        for v in vals[1:]:
            parts.append(f"CAST(coalesce({c} = {q(v)}, false) AS INTEGER) AS {c}_{v}")
    return ", ".join(parts)


DEFAULT_FEATURES = ["account_age_days", "hour_of_day", "day_of_week", "amount_to_avg_ratio",
                    "is_high_amount"]

FEATURE_TABLE = ("SELECT " + ", ".join(NUMERIC) + ", is_fraud, "
                 + ", ".join(f"{FEATURE_SQL[f]} AS {f}" for f in DEFAULT_FEATURES)
                 + ", " + onehot_sql() + " FROM clean")

VIEWS = {
    "raw": RAW_SQL, "history": HISTORY_SQL, "responses": RESPONSES_SQL,
    "loaded": LOADED, "typed": TYPED, "coerced": COERCED, "medians": MEDIANS,
    "filled": FILLED, "clean": CLEAN, "feats": FEATURE_TABLE,
}
ORDER = ["raw", "history", "responses", "loaded", "typed", "coerced", "medians", "filled",
         "clean", "feats"]
NEEDS = {"loaded": ["raw"], "typed": ["loaded"], "coerced": ["raw"], "medians": ["coerced"],
         "filled": ["coerced", "medians"], "clean": ["filled"], "feats": ["clean"]}


def with_views(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs for ``views`` and their dependencies."""
    need: set[str] = set()

    def add(v):
        if v in need:
            return
        need.add(v)
        for d in NEEDS.get(v, []):
            add(d)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in ORDER if v in need]
    ctes += [f"{n} AS ({s})" for n, s in extra or []]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


SQL: dict[str, str] = {}


def _sources():
    SQL["load_csv"] = with_views("SELECT * FROM loaded", "loaded")
    per_col = []
    for i, c in enumerate(RAW_COLS):
        per_col.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, "
            f"CASE WHEN count({c}) = 0 THEN 'double' "
            f"WHEN count_if({is_int(c)}) = count({c}) AND count({c}) = count(*) THEN 'bigint' "
            f"WHEN count_if({is_num(c)}) = count({c}) THEN 'double' ELSE 'string' END AS type, "
            f"count({c}) AS non_null FROM loaded")
    SQL["infer_types"] = with_views(" UNION ALL ".join(per_col), "loaded")
    SQL["shape"] = with_views("SELECT count(*) AS n_rows, CAST(12 AS INTEGER) AS n_cols FROM raw", "raw")
    SQL["preview"] = with_views("SELECT * FROM raw ORDER BY transaction_id LIMIT 100", "raw")
    SQL["coerce_target"] = with_views(f"SELECT transaction_id, {num('is_fraud')} AS is_fraud FROM raw", "raw")


def _cleaning():
    SQL["clean_numeric"] = with_views("SELECT transaction_id, " + ", ".join(NUMERIC) + " FROM coerced", "coerced")
    SQL["clean_strings"] = with_views("SELECT transaction_id, " + ", ".join(STRINGS) + " FROM coerced", "coerced")
    SQL["impute_median"] = with_views("SELECT transaction_id, " + ", ".join(NUMERIC) + " FROM filled", "filled")
    SQL["impute_mode"] = with_views("SELECT transaction_id, " + ", ".join(STRINGS) + " FROM filled", "filled")
    SQL["filter_target"] = with_views(
        f"SELECT transaction_id, {num('is_fraud')} AS is_fraud FROM raw WHERE {num('is_fraud')} IN (0.0, 1.0)", "raw")
    SQL["dropped_rows"] = with_views(
        f"SELECT count(*) AS rows_before, CAST(count_if(NOT coalesce({num('is_fraud')} IN (0.0, 1.0), false)) AS BIGINT) AS dropped_rows FROM raw", "raw")
    SQL["parse_timestamps"] = with_views(
        f"SELECT transaction_id, TRY_CAST({strip('timestamp')} AS TIMESTAMP) AS timestamp, "
        f"TRY_CAST({strip('user_signup_date')} AS TIMESTAMP) AS user_signup_date FROM raw", "raw")
    SQL["clean"] = with_views("SELECT * FROM clean", "clean")
    valid = f"coalesce({num('is_fraud')} IN (0.0, 1.0), false)"
    rows = []
    step = 0

    def add(stepname, col, method, numv, text, affected):
        nonlocal step
        step += 1
        colv = q(col) if col else "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT CAST({step} AS INTEGER) AS step_no, '{stepname}' AS step, {colv} AS column, "
                    f"'{method}' AS method, CAST({numv} AS DOUBLE) AS fill_number, "
                    f"CAST({text} AS VARCHAR) AS fill_text, CAST({affected} AS BIGINT) AS rows_affected FROM agg, medians")

    for c in NUMERIC:
        add("coerce_numeric", c, "to_number", "NULL", "NULL", 0)
    for c in STRINGS:
        add("normalise_strings", c, "strip_lower", "NULL", "NULL", 0)
    for c in NUMERIC:
        if c != "is_international" and c != "prior_transactions_24h":
            add("impute", c, "median", f"medians.{c}", "NULL", f"null_{c}")
    for c in STRINGS:
        add("impute", c, "mode", "NULL", _mode(c), f"null_{c}")
    add("filter_target", "is_fraud", "keep_0_1", "NULL", "NULL", "n - kept")
    for c in ["timestamp", "user_signup_date"]:
        add("parse_timestamps", c, "to_timestamp", "NULL", "NULL", f"badts_{c}")
    add("shape", None, "rows_before", "NULL", "NULL", "n")
    add("shape", None, "rows_after", "NULL", "NULL", "kept")
    agg = ("SELECT count(*) AS n, count_if(" + valid + ") AS kept, "
           + ", ".join(f"count_if({c} IS NULL) AS null_{c}" for c in NUMERIC + STRINGS) + ", "
           + ", ".join(f"count_if({valid} AND {c} IS NOT NULL AND TRY_CAST({strip(c)} AS TIMESTAMP) IS NULL) AS badts_{c}"
                       for c in ["timestamp", "user_signup_date"]) + " FROM coerced")
    SQL["cleaning_report"] = with_views(" UNION ALL ".join(rows), "coerced", "medians",
                                        extra=[("agg", agg)])


def _features():
    for f, expr in FEATURE_SQL.items():
        cols = [f"{FEATURE_SQL[d]} AS {d}" for d in FEATURE_DEPS.get(f, [])] + [f"{expr} AS {f}"]
        SQL[f"feat_{f}"] = with_views("SELECT transaction_id, " + ", ".join(cols) + " FROM clean", "clean")
    sel = ["log_amount", "day_of_week", "is_weekend", "account_age_days", "is_new_account"]
    SQL["feature_select"] = with_views(
        "SELECT transaction_id, " + ", ".join(f"{FEATURE_SQL[f]} AS {f}" for f in sel) + " FROM clean", "clean")
    SQL["one_hot"] = with_views("SELECT transaction_id, " + onehot_sql() + " FROM clean", "clean")
    SQL["drop_non_features"] = with_views("SELECT " + ", ".join(NUMERIC) + ", is_fraud FROM clean", "clean")
    SQL["feature_table"] = with_views("SELECT * FROM feats", "feats")
    SQL["prior_transactions_24h"] = (
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY "
        "PRECEDING AND CURRENT ROW) - 1 AS prior_transactions_24h FROM events")
    SQL["avg_amount_7d"] = (
        "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7' DAY "
        "PRECEDING AND CURRENT ROW), 6) AS avg_amount_7d FROM events")


_sources()
_cleaning()
_features()


# ---- 2.2 profiling ------------------------------------------------------------------
TYPED_NUMERIC = ["avg_amount_7d", "prior_transactions_24h", "is_international", "is_fraud"]
TYPED_STRINGS = ["transaction_id", "user_id", "timestamp", "user_signup_date", "amount",
                 "merchant_category", "transaction_type", "device_type"]
TYPED_TYPES = {"transaction_id": "string", "user_id": "string", "timestamp": "string",
               "user_signup_date": "string", "amount": "string", "avg_amount_7d": "double",
               "prior_transactions_24h": "bigint", "is_international": "bigint",
               "merchant_category": "string", "transaction_type": "string",
               "device_type": "string", "is_fraud": "double"}
ATTRIBUTES = ["user_signup_date", "amount", "avg_amount_7d", "prior_transactions_24h",
              "is_international", "merchant_category", "transaction_type", "device_type", "is_fraud"]


def _top(c: str, what: str) -> str:
    return (f"(SELECT {what} FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM typed "
            f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")


def _describe_sql(include_all: bool) -> str:
    parts = []
    for c in RAW_COLS:
        if c in TYPED_NUMERIC:
            extra = ("CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
                     "CAST(NULL AS BIGINT) AS freq, ") if include_all else ""
            parts.append(
                f"SELECT '{c}' AS column, count({c}) AS count, {extra}round(avg({c}), 6) AS mean, "
                f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
                f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
                f"round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM typed")
        elif include_all:
            nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "q25", "q50", "q75", "max"))
            parts.append(
                f"SELECT '{c}' AS column, count({c}) AS count, count(DISTINCT {c}) AS \"unique\", "
                f"{_top(c, 'v')} AS top, {_top(c, 'n')} AS freq, {nulls} FROM typed")
    return " UNION ALL ".join(parts)


def _per_col(template: str, cols: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c, i=RAW_COLS.index(c) if c in RAW_COLS else i)
                              for i, c in enumerate(cols))


def _moments_sql(cols):
    return "SELECT " + ", ".join(
        f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}, count({c}) AS cnt_{c}" for c in cols) + " FROM typed"


def _outlier_rows(cols):
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, "
        f"CAST(count_if(std_{c} > 0 AND abs({c} - mean_{c}) > 3 * std_{c}) AS BIGINT) AS n_outliers, "
        f"max(cnt_{c}) AS cnt FROM typed, moments" for i, c in enumerate(cols))


def _profiling():
    SQL["describe_numeric"] = with_views(_describe_sql(False), "typed")
    SQL["describe_all"] = with_views(_describe_sql(True), "typed")
    SQL["target_distribution"] = with_views(
        "SELECT is_fraud, count(*) AS n FROM typed WHERE is_fraud IS NOT NULL GROUP BY 1", "typed")
    SQL["target_share"] = with_views(
        "SELECT is_fraud, n, round(n * 100.0 / sum(n) OVER (), 1) AS share FROM "
        "(SELECT is_fraud, count(*) AS n FROM typed WHERE is_fraud IS NOT NULL GROUP BY 1)", "typed")
    SQL["positive_rate_mean"] = with_views(
        "SELECT round(avg(is_fraud) * 100, 6) AS positive_rate FROM typed", "typed")
    SQL["positive_rate_valid"] = with_views(
        "SELECT round(coalesce(count_if(is_fraud = 1) * 100.0 / nullif(count(is_fraud), 0), 0.0), 6) "
        "AS positive_rate FROM typed", "typed")
    miss = _per_col("SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, "
                    "CAST(count_if({c} IS NULL) AS BIGINT) AS missing, count(*) AS n FROM typed", RAW_COLS)
    SQL["missing_by_column"] = with_views(
        "SELECT \"column\", missing, round(missing * 100.0 / n, 2) AS pct FROM m WHERE missing > 0",
        "typed", extra=[("m", miss)])
    SQL["missing_top5"] = with_views(
        "SELECT CAST(rank AS INTEGER) AS rank, \"column\", missing, pct, more_columns FROM ("
        "SELECT row_number() OVER (ORDER BY missing DESC, position) AS rank, \"column\", missing, "
        "round(missing * 100.0 / n, 1) AS pct, greatest(count(*) OVER () - 5, 0) AS more_columns "
        "FROM m WHERE missing > 0) WHERE rank <= 5", "typed", extra=[("m", miss)])
    SQL["duplicate_rows"] = with_views(
        "SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS k FROM typed "
        f"GROUP BY {', '.join(ATTRIBUTES)})", "typed")
    non_target = [c for c in TYPED_NUMERIC if c != "is_fraud"]
    SQL["outliers_3sigma"] = with_views(
        "SELECT \"column\", n_outliers FROM o WHERE n_outliers > 0", "typed",
        extra=[("moments", _moments_sql(non_target)), ("o", _outlier_rows(non_target))])
    SQL["outliers_top3"] = with_views(
        "SELECT CAST(rank AS INTEGER) AS rank, \"column\", n_outliers FROM (SELECT row_number() OVER "
        "(ORDER BY n_outliers DESC, position) AS rank, \"column\", n_outliers FROM o "
        "WHERE n_outliers > 0 AND cnt >= 10) WHERE rank <= 3", "typed",
        extra=[("moments", _moments_sql(TYPED_NUMERIC)), ("o", _outlier_rows(TYPED_NUMERIC))])
    SQL["negative_values"] = with_views(
        f"SELECT 'amount' AS column, CAST(count_if({num('amount')} < 0) AS BIGINT) AS negatives FROM typed UNION ALL "
        "SELECT 'avg_amount_7d', CAST(count_if(avg_amount_7d < 0) AS BIGINT) FROM typed UNION ALL "
        "SELECT 'prior_transactions_24h', CAST(count_if(prior_transactions_24h < 0) AS BIGINT) FROM typed", "typed")
    SQL["target_quality"] = with_views(
        "SELECT (SELECT count(*) FROM v) AS n_distinct, "
        "(SELECT coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x), '') FROM v) AS distinct_values, "
        "(SELECT CAST(count_if(is_fraud IS NULL) AS BIGINT) FROM typed) AS n_missing, "
        "(SELECT CAST(count_if(x NOT IN (0.0, 1.0)) AS BIGINT) FROM v) AS n_unexpected, "
        "(SELECT coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x), '') FROM v "
        "WHERE x NOT IN (0.0, 1.0)) AS unexpected_values", "typed",
        extra=[("v", "SELECT DISTINCT is_fraud AS x FROM typed WHERE is_fraud IS NOT NULL")])
    card_cols = [c for c in TYPED_STRINGS if c != "transaction_id"]
    card = " UNION ALL ".join(
        f"SELECT '{c}' AS column, (SELECT count(DISTINCT {c}) FROM typed) AS n_unique, "
        f"(SELECT string_agg(v, ', ' ORDER BY k) FROM (SELECT {c} AS v, min(transaction_id) AS k FROM typed "
        f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k LIMIT 5)) AS sample" for c in card_cols)
    SQL["category_cardinality"] = with_views(card, "typed")
    SQL["column_summary"] = with_views(" UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, '{TYPED_TYPES[c]}' AS type, "
        f"count({c}) AS non_null, round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_pct, "
        f"count(DISTINCT {c}) AS n_unique FROM typed" for i, c in enumerate(RAW_COLS)), "typed")
    all_cols = ", ".join(RAW_COLS)
    missing_cells = " + ".join(f"count_if({c} IS NULL)" for c in RAW_COLS)
    SQL["overview"] = with_views(
        "SELECT n_rows, CAST(12 AS INTEGER) AS n_cols, round(coalesce(cells * 100.0 / nullif(n_rows * 12, 0), 0.0), 1) "
        "AS missing_cells_pct, duplicate_rows, round(rate, 1) AS positive_rate FROM "
        f"(SELECT count(*) AS n_rows, {missing_cells} AS cells, "
        "coalesce(count_if(is_fraud = 1) * 100.0 / nullif(count(is_fraud), 0), 0.0) AS rate FROM typed), "
        f"(SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS k FROM typed GROUP BY {all_cols}))",
        "typed")
    SQL["class_imbalance"] = with_views(
        "SELECT positive_rate, positive_rate < 10 AS imbalanced FROM (SELECT round(coalesce(count_if(is_fraud = 1) * 100.0 "
        "/ nullif(count(is_fraud), 0), 0.0), 6) AS positive_rate FROM typed)", "typed")
    issues = f"""
        SELECT 0 AS ord, 'missing_values' AS kind, round(missing * 100.0 / n, 6) AS severity, "column",
               (SELECT count(*) FROM m WHERE missing > 0) AS n
        FROM (SELECT * FROM m WHERE missing > 0 ORDER BY missing DESC, position LIMIT 1)
        UNION ALL
        SELECT 1, 'duplicates', round(d * 100.0 / (SELECT count(*) FROM typed), 6), NULL, d
        FROM (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS d FROM (SELECT count(*) AS k FROM typed GROUP BY {all_cols})) WHERE d > 0
        UNION ALL
        SELECT 2, 'target_missing', round(t * 100.0 / n, 6), 'is_fraud', t
        FROM (SELECT count_if(is_fraud IS NULL) AS t, count(*) AS n FROM loaded) WHERE t > 0
        UNION ALL
        SELECT 3, 'target_unexpected', 90.0, 'is_fraud', u
        FROM (SELECT count(DISTINCT is_fraud) AS u FROM typed WHERE is_fraud NOT IN (0.0, 1.0)) WHERE u > 0
        UNION ALL
        SELECT 4, 'class_imbalance', 80.0, 'is_fraud', NULL
        FROM (SELECT coalesce(count_if(is_fraud = 1) * 100.0 / nullif(count(is_fraud), 0), 0.0) AS r FROM typed) WHERE r < 10
        UNION ALL
        SELECT 5, 'outliers', CAST(n_outliers AS DOUBLE), "column", n_outliers
        FROM (SELECT max(n_outliers) AS n_outliers, string_agg("column", ', ' ORDER BY n_outliers DESC, position) AS "column"
              FROM (SELECT * FROM o WHERE n_outliers > 0 AND cnt >= 10 ORDER BY n_outliers DESC, position LIMIT 3)) WHERE n_outliers IS NOT NULL"""
    SQL["quality_issues"] = with_views(
        "SELECT CAST(rank AS INTEGER) AS rank, kind, CAST(severity AS DOUBLE) AS severity, CAST(\"column\" AS VARCHAR) AS \"column\", "
        "CAST(n AS BIGINT) AS n FROM (SELECT row_number() OVER (ORDER BY severity DESC, ord) AS rank, * FROM i) "
        "WHERE rank <= 5", "typed",
        extra=[("m", miss), ("moments", _moments_sql(TYPED_NUMERIC)), ("o", _outlier_rows(TYPED_NUMERIC)),
               ("i", issues)])
    hist_cols = non_target
    edges = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS column, CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE CAST(min({c}) AS DOUBLE) END AS a, "
        f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE CAST(max({c}) AS DOUBLE) END AS b FROM typed"
        for i, c in enumerate(hist_cols))
    hits = " UNION ALL ".join(
        f"SELECT {i} AS i, CAST(least(floor(({c} - a) * 30 / (b - a)), 29) AS INTEGER) AS bin FROM typed, "
        f"(SELECT a, b FROM edges WHERE i = {i}) WHERE {c} IS NOT NULL" for i, c in enumerate(hist_cols))
    SQL["histograms"] = with_views(
        "SELECT e.column, CAST(g.bin AS INTEGER) AS bin, round(e.a + g.bin * ((e.b - e.a) / 30), 6) AS lo, "
        "round(e.a + (g.bin + 1) * ((e.b - e.a) / 30), 6) AS hi, CAST(coalesce(h.n, 0) AS BIGINT) AS n "
        "FROM edges e CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g "
        "LEFT JOIN (SELECT i, bin, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.i = e.i AND h.bin = g.bin "
        "WHERE e.a IS NOT NULL", "typed", extra=[("edges", edges), ("hits", hits)])

    def corr(a, b):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        den = f"(stddev_pop({a}) FILTER (WHERE {both}) * stddev_pop({b}) FILTER (WHERE {both}))"
        return (f"round(CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({a}, {b}) FILTER (WHERE {both}) / {den} END, 6)")
    SQL["correlation_matrix"] = with_views(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {corr(a, b)} AS r FROM typed"
        for a in TYPED_NUMERIC for b in TYPED_NUMERIC), "typed")
    box_cols = non_target
    quart = " UNION ALL ".join(
        f"SELECT is_fraud AS g, '{c}' AS column, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, "
        f"quantile_cont({c}, 0.75) AS q3 FROM typed WHERE is_fraud IS NOT NULL GROUP BY is_fraud" for c in box_cols)
    whisk = " UNION ALL ".join(
        f"SELECT q.g, q.column, min(CASE WHEN x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x END) AS whisker_lo, "
        f"max(CASE WHEN x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x END) AS whisker_hi, "
        f"CAST(count_if(x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_fliers "
        f"FROM (SELECT is_fraud AS g, CAST({c} AS DOUBLE) AS x FROM typed) t JOIN quart q ON q.g = t.g AND q.column = '{c}' "
        f"GROUP BY q.g, q.column" for c in box_cols)
    SQL["boxplot_by_target"] = with_views(
        "SELECT q.g AS is_fraud, q.column, round(q.q1, 6) AS q1, round(q.med, 6) AS median, round(q.q3, 6) AS q3, "
        "CAST(w.whisker_lo AS DOUBLE) AS whisker_lo, CAST(w.whisker_hi AS DOUBLE) AS whisker_hi, w.n_fliers "
        "FROM quart q JOIN whisk w ON q.g = w.g AND q.column = w.column", "typed",
        extra=[("quart", quart), ("whisk", whisk)])


_profiling()


# ---- 2.6 evaluation ---------------------------------------------------------------------
SCORED = ("SELECT transaction_id, transaction_type, device_type, is_fraud AS label, "
          "CASE WHEN amount > 100 THEN 1.0 ELSE 0.0 END AS prediction FROM clean")
VIEWS["scored"] = SCORED
ORDER.append("scored")
NEEDS["scored"] = ["clean"]


def _metric_exprs():
    tp = "count_if(label = 1 AND prediction = 1)"
    fp = "count_if(label <> 1 AND prediction = 1)"
    fn = "count_if(label = 1 AND prediction <> 1)"
    r = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 4)"
    return {"accuracy": r("count_if(label = prediction)", "count(*)"),
            "precision": r(tp, f"{tp} + {fp}"), "recall": r(tp, f"{tp} + {fn}"),
            "f1": r(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")}


def _evaluation():
    m = _metric_exprs()
    for k, e in m.items():
        SQL[f"metric_{k}"] = with_views(f"SELECT {e} AS {k} FROM scored", "scored")
    SQL["evaluate_grouped"] = with_views(
        "SELECT transaction_type, " + ", ".join(f"{e} AS {k}" for k, e in m.items())
        + " FROM scored GROUP BY transaction_type", "scored")
    cm = ("SELECT l.c AS label, p.c AS prediction, coalesce(n, 0) AS n FROM classes l CROSS JOIN classes p "
          "LEFT JOIN (SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2) k "
          "ON k.label = l.c AND k.prediction = p.c")
    classes = ("SELECT DISTINCT c FROM (SELECT label AS c FROM scored UNION ALL SELECT prediction FROM scored) "
               "WHERE c IS NOT NULL")
    SQL["confusion_matrix"] = with_views(cm, "scored", extra=[("classes", classes)])
    per = ("SELECT c, tp, support, pred, coalesce(CAST(tp AS DOUBLE) / nullif(pred, 0), 0.0) AS p, "
           "coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS r, "
           "coalesce(CAST(2 * tp AS DOUBLE) / nullif(pred + support, 0), 0.0) AS f FROM "
           "(SELECT label AS c, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp, sum(n) AS support FROM cm GROUP BY 1) a "
           "JOIN (SELECT prediction AS c2, sum(n) AS pred FROM cm GROUP BY 1) b ON a.c = b.c2")
    report = (
        "SELECT CAST(c AS VARCHAR) AS class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, "
        "CAST(support AS BIGINT) AS support FROM per UNION ALL "
        "SELECT 'accuracy', NULL, NULL, round(coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(support), 0), 0.0), 4), "
        "CAST(sum(support) AS BIGINT) FROM per UNION ALL "
        "SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM per UNION ALL "
        "SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), "
        "round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM per")
    SQL["classification_report"] = with_views(report, "scored", extra=[("classes", classes), ("cm", cm), ("per", per)])


_evaluation()


# ---- 2.7 recommendations -------------------------------------------------------------------
VALID_FEATURES_SQL = ("['account_age_days', 'hour_of_day', 'day_of_week', 'amount_to_avg_ratio', "
                      "'is_high_amount', 'log_amount', 'is_new_account', 'is_night_txn', 'amount_deviation', "
                      "'high_velocity', 'amount_squared', 'amount_x_velocity', 'is_weekend', 'txn_per_avg_ratio']")
DEFAULT_FEATURES_SQL = ("'account_age_days,hour_of_day,day_of_week,amount_to_avg_ratio,is_high_amount,"
                        "log_amount,is_new_account'")


def _recommendations():
    s = "regexp_replace(response_text, '^\\s+|\\s+$', '', 'g')"
    unf = f"regexp_replace(regexp_replace({s}, '(?m)^[^\\S\\n]*```[^\\n]*(\\n|$)', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    parsed = (f"SELECT response_id, CASE WHEN starts_with({s}, '```') THEN {unf} ELSE {s} END AS body FROM responses")
    p = ("SELECT response_id, body, CASE WHEN json_valid(body) THEN coalesce(json_type(body) = 'OBJECT', false) ELSE false END AS ok, "
         "CASE WHEN json_valid(body) THEN body END AS j FROM parsed")
    num = "('BIGINT', 'UBIGINT', 'DOUBLE')"
    feats = (f"CASE WHEN ok AND json_type(j, '$.features_to_add') = 'ARRAY' AND len(kf) > 0 "
             f"THEN array_to_string(kf, ',') ELSE {DEFAULT_FEATURES_SQL} END")
    kf = (f"list_filter(list_transform(json_extract(j, '$.features_to_add[*]'), lambda e: CASE WHEN json_type(e) = 'VARCHAR' "
          f"THEN json_extract_string(e, '$') END), lambda x: list_contains({VALID_FEATURES_SQL}, x))")
    name = ("CASE WHEN json_type(j, '$.model_config') = 'OBJECT' AND json_type(j, '$.model_config.model_name') = 'VARCHAR' "
            "THEN json_extract_string(j, '$.model_config.model_name') END")
    model = (f"CASE WHEN ok AND coalesce({name} IN ('LogisticRegression', 'RandomForestClassifier', "
             f"'GradientBoostingClassifier', 'SVC'), false) THEN {name} ELSE 'RandomForestClassifier' END")
    use_hp = (f"coalesce(ok AND {name} IN ('LogisticRegression', 'RandomForestClassifier', 'GradientBoostingClassifier', 'SVC') "
              "AND (json_type(j, '$.model_config.hyperparameters') = 'OBJECT' OR json_type(j, '$.model_config.hyperparameters') IS NULL), false)")
    v = lambda k: f"json_extract(j, '$.model_config.hyperparameters.{k}')"
    isnum = lambda k: f"json_type({v(k)}) IN {num}"
    x = lambda k: f"CAST(json_extract_string(j, '$.model_config.hyperparameters.{k}') AS DOUBLE)"
    clamp = lambda k, lo, hi: f"greatest({lo}, least({hi}, {x(k)}))"
    c_expr = (f"CASE WHEN use_hp AND model = 'LogisticRegression' THEN CASE WHEN {isnum('C')} THEN {clamp('C', 0.01, 10.0)} END "
              f"WHEN use_hp AND model = 'SVC' THEN CASE WHEN {isnum('C')} THEN {clamp('C', 0.1, 10.0)} END END")
    ne = (f"CASE WHEN NOT use_hp THEN 100 WHEN model IN ('RandomForestClassifier', 'GradientBoostingClassifier') "
          f"THEN CASE WHEN {isnum('n_estimators')} THEN CAST(trunc({clamp('n_estimators', 50, 300)}) AS BIGINT) END END")
    md = (f"CASE WHEN use_hp AND model = 'RandomForestClassifier' THEN CASE WHEN {isnum('max_depth')} THEN CAST(trunc({clamp('max_depth', 5, 30)}) AS BIGINT) END "
          f"WHEN use_hp AND model = 'GradientBoostingClassifier' THEN CASE WHEN {isnum('max_depth')} THEN CAST(trunc({clamp('max_depth', 3, 10)}) AS BIGINT) END END")
    lr = (f"CASE WHEN use_hp AND model = 'GradientBoostingClassifier' THEN CASE WHEN {isnum('learning_rate')} "
          f"THEN {clamp('learning_rate', 0.01, 0.3)} END END")
    kern = ("CASE WHEN use_hp AND model = 'SVC' AND json_type(" + v('kernel') + ") = 'VARCHAR' AND "
            "json_extract_string(j, '$.model_config.hyperparameters.kernel') IN ('rbf', 'linear') "
            "THEN json_extract_string(j, '$.model_config.hyperparameters.kernel') END")
    stop = "coalesce(ok AND json_type(j, '$.should_stop') = 'BOOLEAN' AND json_extract_string(j, '$.should_stop') = 'true', false)"
    reason = ("CASE WHEN NOT ok THEN 'Fallback defaults applied.' WHEN json_type(j, '$.reasoning') = 'VARCHAR' "
              "THEN json_extract_string(j, '$.reasoning') ELSE coalesce(CAST(json_extract(j, '$.reasoning') AS VARCHAR), '') END")
    base = f"SELECT response_id, ok, j, {feats} AS features_to_add, {model} AS model, {use_hp} AS use_hp FROM (SELECT *, {kf} AS kf FROM p)"
    full = (f"SELECT response_id, ok, features_to_add, model AS model_name, {c_expr} AS C, {ne} AS n_estimators, "
            f"{md} AS max_depth, {lr} AS learning_rate, {kern} AS kernel, {stop} AS should_stop, {reason} AS reasoning FROM base")
    ex = [("parsed", parsed), ("p", p), ("base", base), ("v", full)]
    SQL["parse_responses"] = with_views("SELECT response_id, body, ok FROM p", "responses", extra=ex[:2])
    SQL["valid_features"] = with_views("SELECT response_id, features_to_add FROM v", "responses", extra=ex)
    SQL["valid_model"] = with_views("SELECT response_id, model_name FROM v", "responses", extra=ex)
    SQL["clamp_hyperparameters"] = with_views(
        "SELECT response_id, model_name, C, n_estimators, max_depth, learning_rate, kernel FROM v", "responses", extra=ex)
    SQL["valid_stop"] = with_views("SELECT response_id, should_stop FROM v", "responses", extra=ex)
    SQL["validate_recommendations"] = with_views("SELECT * FROM v", "responses", extra=ex)


_recommendations()


# ---- 2.8 history ---------------------------------------------------------------------------
MODEL_LABEL = "replace(split_part(model_report, chr(10), 1), 'Model: ', '')"
HIST_COLS = ("run_id, CAST(iteration AS INTEGER) AS iteration, model_name, model_report, feature_report, "
             "tp, fp, fn, tn, accuracy, prec, recall, f1, should_stop")


def _diag_sql(code: str) -> str:
    """SQL for one diagnostic: (run_id, iteration, level, code, model, value)
    and the compared or best round's figures."""
    def sel(lvl, val, it="CAST(iteration AS INTEGER)", mdl=MODEL_LABEL, **known):
        detail = ", ".join(f"CAST({known.get(c, 'NULL')} AS {t}) AS {c}" for c, t in (
            ("previous_model", "VARCHAR"), ("previous_f1", "DOUBLE"), ("f1", "DOUBLE"), ("precision", "DOUBLE"), ("recall", "DOUBLE")))
        return (f"SELECT run_id, {it} AS iteration, '{lvl}' AS level, '{code}' AS code, {mdl} AS model, "
                f"round(CAST({val} AS DOUBLE), 6) AS value, {detail}")
    rec, prec, acc, f1 = "coalesce(recall, 0.0)", "coalesce(prec, 0.0)", "coalesce(accuracy, 0.0)", "coalesce(f1, 0.0)"
    if code == "zero_recall":
        return sel("warning", rec) + f" FROM history WHERE {rec} = 0"
    if code == "low_recall":
        return sel("warning", rec) + f" FROM history WHERE {rec} > 0 AND {rec} < 0.3"
    if code == "zero_precision":
        return sel("warning", prec) + f" FROM history WHERE {prec} = 0 AND {rec} > 0"
    if code == "accuracy_paradox":
        return sel("warning", acc) + f" FROM history WHERE {acc} > 0.85 AND {f1} < 0.15"
    prev = (f"SELECT * FROM (SELECT *, lag(coalesce(f1, 0.0)) OVER w AS prev_f1, lag({MODEL_LABEL}) OVER w AS prev_model "
            "FROM history WINDOW w AS (PARTITION BY run_id ORDER BY iteration)) WHERE prev_f1 IS NOT NULL")
    both = {"previous_model": "prev_model", "previous_f1": "prev_f1", "f1": f1}
    if code == "f1_regression":
        return sel("warning", "prev_f1 - coalesce(f1, 0.0)", **both) + f" FROM ({prev}) WHERE coalesce(f1, 0.0) < prev_f1 AND prev_f1 > 0"
    if code == "f1_gain":
        return sel("positive", "coalesce(f1, 0.0) - prev_f1", **both) + f" FROM ({prev}) WHERE coalesce(f1, 0.0) > prev_f1"
    flags = ("SELECT run_id, count(*) AS n_rounds, count(DISTINCT (length(coalesce(feature_report, '')) - "
             "length(replace(coalesce(feature_report, ''), 'Created:', ''))) // 8) AS n_sizes, "
             "bool_and(contains(lower(coalesce(feature_report, '')), 'default feature set')) AS default_only, "
             "bool_or(contains(coalesce(feature_report, ''), 'LLM-recommended')) AS recommended "
             "FROM history GROUP BY run_id HAVING count(*) > 1")
    nil = ("CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)")
    if code == "feature_set_changed":
        return sel("insight", "n_sizes", *nil) + f" FROM ({flags}) WHERE n_sizes > 1"
    if code == "default_only":
        return sel("warning", "NULL", *nil) + f" FROM ({flags}) WHERE default_only"
    if code == "recommendation_used":
        return sel("positive", "NULL", *nil) + f" FROM ({flags}) WHERE recommended AND NOT default_only"
    best = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(f1, 0.0) DESC, iteration) AS rn "
            "FROM history) WHERE rn = 1 AND coalesce(f1, 0.0) > 0")
    return sel("insight", f1, f1=f1, precision=prec, recall=rec) + f" FROM ({best})"


DIAG_CODES = ["zero_recall", "low_recall", "zero_precision", "accuracy_paradox", "f1_regression",
              "f1_gain", "feature_set_changed", "default_only", "recommendation_used", "best_model"]


def _history():
    SQL["history_append"] = with_views(f"SELECT {HIST_COLS} FROM history", "history")
    created = "regexp_extract_all(feature_report, '(?m)^\\s*Created:\\s*([^=\\s]+)', 1)"
    used = f"list_filter({created}, lambda x: list_contains({VALID_FEATURES_SQL}, x))"
    SQL["history_features"] = with_views(
        f"SELECT run_id, CAST(iteration AS INTEGER) AS iteration, array_to_string({used}, ',') AS features_used FROM history",
        "history")
    SQL["history_unused_features"] = with_views(
        f"SELECT run_id, CAST(iteration AS INTEGER) AS iteration, array_to_string(list_filter({VALID_FEATURES_SQL}, "
        f"lambda x: NOT list_contains({used}, x)), ',') AS features_unused FROM history", "history")
    first = "split_part(model_report, chr(10), 1)"
    pat = "'^Model:\\s*(\\w+)\\((.*?)\\)'"
    inner = f"regexp_extract({first}, {pat}, 2)"
    pairs = (f"list_transform(list_filter(list_transform(string_split({inner}, ','), lambda x: trim(x)), lambda x: contains(x, '=')), "
             f"lambda x: trim(split_part(x, '=', 1)) || '=' || trim(substr(x, strpos(x, '=') + 1)))")
    SQL["history_model_config"] = with_views(
        f"SELECT run_id, CAST(iteration AS INTEGER) AS iteration, CASE WHEN regexp_matches({first}, {pat}) "
        f"THEN regexp_extract({first}, {pat}, 1) ELSE 'LogisticRegression' END AS config_model, "
        f"CASE WHEN regexp_matches({first}, {pat}) THEN array_to_string(list_sort({pairs}), ', ') ELSE 'C=1.0' END "
        f"AS config_params FROM history", "history")
    reason = ("CASE WHEN iteration >= 2 THEN 'max_iterations' WHEN coalesce(f1, 0.0) >= 0.85 THEN 'f1_threshold' "
              "WHEN coalesce(should_stop, false) AND iteration >= 1 THEN 'advisor_stop' ELSE 'continue' END")
    SQL["decide"] = with_views(
        f"SELECT run_id, CAST(iteration AS INTEGER) AS iteration, {reason} = 'continue' AS should_continue, "
        f"CAST(iteration + 1 AS INTEGER) AS next_iteration, {reason} AS reason FROM history", "history")
    SQL["best_round"] = with_views(
        "SELECT run_id, CAST(iteration AS INTEGER) AS iteration, model_name, f1, accuracy, prec, recall FROM "
        "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(f1, 0.0) DESC, iteration) AS rn FROM history) "
        "WHERE rn = 1", "history")
    SQL["round_metrics"] = with_views(
        f"SELECT run_id, CAST(iteration AS INTEGER) AS iteration, {MODEL_LABEL} AS model, m.metric, "
        "CASE m.metric WHEN 'accuracy' THEN accuracy WHEN 'precision' THEN prec WHEN 'recall' THEN recall ELSE f1 END AS value "
        "FROM history CROSS JOIN (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) m(metric)", "history")
    SQL["f1_change_total"] = with_views(
        "SELECT run_id, count(*) AS n_rounds, round(arg_max(coalesce(f1, 0.0), iteration) - arg_min(coalesce(f1, 0.0), iteration), 6) "
        "AS f1_change FROM history GROUP BY run_id HAVING count(*) > 1", "history")
    for code in DIAG_CODES:
        SQL[f"diag_{code}"] = with_views(_diag_sql(code), "history")
    SQL["diagnose"] = with_views(" UNION ALL ".join(_diag_sql(c) for c in DIAG_CODES), "history")


_history()


# ---- 2.5 split, scaling, scoring ---------------------------------------------------------------
FEATS_K = FEATURE_TABLE.replace("SELECT ", "SELECT transaction_id, ", 1)
VIEWS["feats_k"] = FEATS_K
ORDER.append("feats_k")
NEEDS["feats_k"] = ["clean"]
FEATURE_COLS = (NUMERIC + DEFAULT_FEATURES
                + [f"{c}_{v}" for c, vals in CATEGORIES.items() for v in vals[1:]])


def _modeling():
    filled = "SELECT transaction_id, is_fraud, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURE_COLS) + " FROM feats_k"
    split = ("SELECT *, CASE WHEN row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || transaction_id)) "
             "<= ceil(0.2 * count(*) OVER (PARTITION BY is_fraud)) THEN 'test' ELSE 'train' END AS split FROM zfilled")
    ex = [("zfilled", filled), ("split", split)]
    SQL["fill_zero"] = with_views("SELECT * FROM zfilled", "feats_k", extra=ex[:1])
    SQL["stratified_split"] = with_views("SELECT transaction_id, is_fraud, split FROM split", "feats_k", extra=ex)
    SQL["balanced_weights"] = with_views(
        "SELECT transaction_id, is_fraud, round(count(*) OVER () / ((SELECT count(DISTINCT is_fraud) FROM split WHERE split = 'train') "
        "* count(*) OVER (PARTITION BY is_fraud)), 6) AS weight FROM split WHERE split = 'train'", "feats_k", extra=ex)
    stats = "SELECT " + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in FEATURE_COLS
    ) + " FROM split WHERE split = 'train'"
    terms = ", ".join(f"({q(c)})" for c in FEATURE_COLS + ["(intercept)"])
    SQL["optimality_logistic"] = with_views(
        "SELECT term, (SELECT count(*) FROM split WHERE split = 'train') AS n_train, true AS optimal "
        f"FROM (VALUES {terms}) t(term)", "feats_k", extra=ex)
    SQL["standard_scale"] = with_views(
        "SELECT transaction_id, split, " + ", ".join(
            f"round((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END, 6) AS {c}"
            for c in FEATURE_COLS) + " FROM split, stats", "feats_k", extra=ex + [("stats", stats)])
    coef = {"amount": 0.02, "amount_to_avg_ratio": 0.5, "is_high_amount": 1.0, "hour_of_day": -0.01}
    score = "CAST(-2.5 AS DOUBLE)"
    for c, w in coef.items():
        score = f"({score} + coalesce(CAST({c} AS DOUBLE), 0.0) * {w})"
    SQL["linear_score"] = with_views(
        f"SELECT transaction_id, round({score}, 6) AS score, CASE WHEN {score} > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS prediction "
        "FROM feats_k", "feats_k")


_modeling()

SQL["profile_and_clean"] = (
    "SELECT 'issue' AS section, CAST(rank AS BIGINT) AS position, kind AS name, \"column\", round(CAST(severity AS DOUBLE), 6) AS value, "
    f"CAST(NULL AS VARCHAR) AS text, CAST(n AS BIGINT) AS n FROM ({SQL['quality_issues']}) UNION ALL "
    "SELECT 'cleaning', CAST(step_no AS BIGINT), step, \"column\", round(CAST(fill_number AS DOUBLE), 6), fill_text, "
    f"CAST(rows_affected AS BIGINT) FROM ({SQL['cleaning_report']}) UNION ALL "
    + " UNION ALL ".join(f"SELECT 'clean', CAST({i + 1} AS BIGINT), 'not_missing', '{c}', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), "
                         f"count({c}) FROM ({SQL['clean']})" for i, c in enumerate(RAW_COLS)))


def _data_summary():
    schema = " UNION ALL ".join(f"SELECT 'schema' AS section, '{c}' AS name, 'type' AS attribute, "
                                f"'{TYPED_TYPES[c]}' AS value" for c in RAW_COLS)
    stats = ["count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]
    st = " UNION ALL ".join(
        f"SELECT 'statistics' AS section, \"column\" AS name, '{a}' AS attribute, CAST(\"{a}\" AS VARCHAR) AS value FROM d"
        for a in stats)
    sample = " UNION ALL ".join(
        f"SELECT 'sample' AS section, '{c}' AS name, 'row ' || CAST(rn - 1 AS VARCHAR) AS attribute, "
        f"CAST({c} AS VARCHAR) AS value FROM head" for c in RAW_COLS)
    head = "SELECT *, row_number() OVER (ORDER BY transaction_id) AS rn FROM typed ORDER BY transaction_id LIMIT 5"
    SQL["data_summary"] = with_views(
        f"{schema} UNION ALL SELECT * FROM ({st}) WHERE value IS NOT NULL UNION ALL {sample}", "typed",
        extra=[("d", _describe_sql(True)), ("head", head)])


_data_summary()


def _other_tables():
    num = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    SQL["describe_lineitem"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in num)
    box = []
    for c in num[3:]:
        quart = (f"SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM t GROUP BY g")
        box.append(
            f"(WITH t AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS g, CAST({c} AS DOUBLE) AS x FROM lineitem), q AS ({quart}) "
            f"SELECT q.g AS returned, '{c}' AS column, round(q.q1, 6) AS q1, round(q.med, 6) AS median, round(q.q3, 6) AS q3, "
            "min(CASE WHEN x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x END) AS whisker_lo, max(CASE WHEN x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x END) AS whisker_hi, "
            "CAST(count_if(x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_fliers "
            "FROM t JOIN q ON t.g = q.g GROUP BY q.g, q.q1, q.med, q.q3)")
    SQL["box_lineitem"] = " UNION ALL ".join(box)
    SQL["split_documents"] = (
        "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) "
        "<= ceil(0.2 * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS split "
        "FROM (SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")


_other_tables()


def _assemble():
    order = (["amount", "avg_amount_7d", "prior_transactions_24h", "is_international"] + DEFAULT_FEATURES
             + [f"{c}_{v}" for c, vals in CATEGORIES.items() for v in vals[1:]])
    arr = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in order)
    SQL["assemble"] = with_views(f"SELECT transaction_id, [{arr}] AS features FROM feats_k", "feats_k")


_assemble()
