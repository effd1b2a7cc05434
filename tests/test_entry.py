import __spark_entry__ as entry_module


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 5 and "average" in df.columns


def test_contract():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 180 and set(oracles) <= set(queries)
    core = set(queries) - set(entry_module.LLM_QUERIES)
    assert core - set(oracles) == {"train_random_forest", "isolation_score", "retrain_all"}


def test_forest_importance(spark):
    from tidewatch.operators import learning
    from tidewatch.sources.views import Tables

    train = learning.failure_features(Tables(spark, "/root/testdata/sf0.001").metrics)
    model = learning.train_random_forest(train, trees=5, depth=3)
    got = learning.forest_importance(model, train).collect()
    assert len(got) == 10 and [r["rank"] for r in got] == list(range(1, 11))
