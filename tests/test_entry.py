import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "is_fraud" in df.columns


def test_every_key_has_a_query():
    from tidewise.plans.catalog import QUERIES
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and len(QUERIES) == 109
    assert set(o) <= set(q)


def test_plans_push_down(spark):
    from tidewise.plans.catalog import QUERIES
    plan = QUERIES["prior_transactions_24h"](spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .executedPlan().toString()
    schemas = [line for line in plan.split("ReadSchema: ")[1:]]
    assert schemas and all("value" not in x.split(">")[0] and "event_type" not in x.split(">")[0] for x in schemas)


def test_single_pass_queries_write_nothing(spark):
    """A query over the raw view reads only the columns it needs."""
    from tidewise.plans.catalog import QUERIES
    plan = QUERIES["shape"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "tables/raw" not in plan
