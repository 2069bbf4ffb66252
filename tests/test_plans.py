import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "mean", "p10", "p90", "count"] and df.count() > 0


def test_scans_read_only_needed_columns(spark):
    from missiva.plans import fixtures as X

    plan = X.letters(spark, "/root/testdata/sf0.001").select("id", "date")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]


def test_notable_rows_are_pruned_before_the_shuffle(spark):
    plan = entry.queries()["connections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
