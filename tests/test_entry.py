import __spark_entry__ as E


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "ord", "place", "total_words"] and df.count() > 0


def test_plans(spark, sf):
    q = E.queries()
    plan = q["filter_metadata"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "embeds" not in plan.split("ReadSchema")[1]
    assert "WindowGroupLimit" in q["knn_store"](spark, sf)._jdf.queryExecution().executedPlan().toString()
