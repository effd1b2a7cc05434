"""Values worked out by hand, boundaries, and deliberate deviations."""

import datetime as dt
import operator as op
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Row, functions as F

from tidewatch.functions import labels, masking, scoring
from tidewatch.functions.conditions import alert_condition
from tidewatch.operators import (
    aggregate, alerts as al, counters, events, latest, learning, logs, models, remediation, selection, store, validation,
)

AT = dt.datetime(2024, 1, 31)


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def metrics(spark, *rows):
    """Rows of (system, name, minutes before the reference time, value)."""
    data = [
        (i, s, n, float(v) if v is not None else None, "percent", '{"a":"1"}', AT - dt.timedelta(minutes=m))
        for i, (s, n, m, v) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "id long, system_id string, name string, value double, unit string, labels string, ts timestamp_ntz"
    )


def systems(spark, *ids):
    return spark.createDataFrame([(i, f"name of {i}") for i in ids], "id string, name string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- status and score ---------------------------------------------------------


def statuses(spark, *rows):
    got = aggregate.system_status(metrics(spark, *rows), systems(spark, "s", "t"), as_of())
    return {r["system_id"]: r["status"] for r in got.collect()}


def test_status_is_decided_by_the_newest_violation(spark):
    old = ("s", "memory_usage", 20, 90), ("s", "cpu_usage", 10, 50)
    assert statuses(spark, *old) == {"s": "warning", "t": "unknown"}
    assert statuses(spark, *old, ("s", "cpu_usage", 5, 95))["s"] == "critical"
    assert statuses(spark, ("s", "cpu_usage", 20, 95), ("s", "memory_usage", 5, 90))["s"] == "warning"
    assert statuses(spark, ("s", "memory_usage", 5, 90), ("s", "error_rate", 5, 6))["s"] == "critical"


def test_status_bounds_are_strict(spark):
    rows = ("s", "cpu_usage", 1, 90), ("s", "memory_usage", 1, 85), ("s", "error_rate", 1, 5)
    assert statuses(spark, *rows)["s"] == "healthy"


def score(spark, *rows, **kw):
    got = aggregate.health_score(metrics(spark, *rows), systems(spark, "s"), as_of(), **kw)
    return one(got)["health_score"]


def test_health_score(spark):
    assert score(spark, ("s", "cpu_usage", 1, 95), ("s", "error_rate", 1, 1)) == 60
    assert score(spark, ("s", "cpu_usage", 1, 80), ("s", "memory_usage", 1, 85)) == 100
    assert score(spark, ("s", "error_rate", 1, 11)) == 0
    assert score(spark, ("x", "error_rate", 1, 1)) == 0
    busy = [("s", "cpu_usage", m, 90) for m in range(1, 7)]
    assert score(spark, *busy) == 0
    assert score(spark, *busy, latest_only=True) == 80


def test_aggregates_leave_nan_out_and_count_it(spark):
    df = metrics(spark, ("s", "cpu_usage", 1, 10), ("s", "cpu_usage", 2, float("nan")), ("s", "cpu_usage", 3, 30),
                 ("gone", "cpu_usage", 1, 99), ("s", "cpu_usage", 61, 99))
    r = one(aggregate.aggregated_metrics(df, systems(spark, "s", "empty"), as_of(), "1h"))
    assert (r["count"], r["average"], r["minimum"], r["maximum"]) == (2, 20, 10, 30)
    assert (r["nan_count"], r["system_count"]) == (1, 2)


def test_overall_status(spark):
    snapshot = spark.createDataFrame([("a", "healthy"), ("b", "healthy"), ("c", "critical"), ("d", "unknown")], "system_id string, status string")
    open_ = spark.createDataFrame(
        [("a", "critical", "acknowledged"), ("b", "low", "active"), ("c", "critical", "resolved")],
        "system_id string, severity string, status string",
    )
    got = {r["system_id"]: r["status"] for r in aggregate.overall_status(snapshot, open_).collect()}
    assert got == {"a": "critical", "b": "warning", "c": "critical", "d": "unknown"}


# --- conditions, labels, alerts -------------------------------------------------

OPERATORS = {"gt": op.gt, ">": op.gt, "gte": op.ge, ">=": op.ge, "lt": op.lt, "<": op.lt, "lte": op.le, "<=": op.le,
             "eq": op.eq, "==": op.eq, "ne": op.ne, "!=": op.ne, "like": lambda a, b: False}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.floats(allow_infinity=True) | st.just(1.0), st.sampled_from(sorted(OPERATORS)), st.just(1.0) | st.floats(),
), min_size=1, max_size=80))
def test_condition_is_ieee(spark, cases):
    df = spark.createDataFrame(cases, "v double, o string, t double")
    got = df.select("v", "o", "t", alert_condition(F.col("v"), F.col("o"), F.col("t")).alias("r")).collect()
    for r in got:
        assert r["r"] == OPERATORS[r["o"]](r["v"], r["t"]), r


def test_labels(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"}, {"b": "3", "c": "4"}), (None, {"c": "4"}), ({"a": "1"}, None)],
                               "m map<string,string>, r map<string,string>")
    got = [r[0] for r in df.select(labels.encode_labels(labels.combine_labels(F.col("m"), F.col("r")))).collect()]
    assert got == ['{"a":"1","b":"3","c":"4"}', '{"c":"4"}', '{"a":"1"}']
    assert df.select(labels.encode_labels(F.col("m"))).collect()[1][0] == "null"


RULES = "id string, system_id string, name string, metric_name string, operator string, threshold double, severity string, labels string, channels string"


def rules(spark, *rows):
    return spark.createDataFrame(
        [(i, "s", f"rule {i}", m, o, float(t), None, None, "email") for i, m, o, t in rows], RULES
    )


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, system_id string, metric_name string, status string").withColumns(
        {"updated_at": as_of(), "resolved_at": F.lit(None).cast("timestamp_ntz")})


def test_rules_on_one_metric_share_an_alert(spark):
    df = metrics(spark, ("s", "cpu_usage", 1, 95))
    checked = al.rules_join_latest(rules(spark, ("r2", "cpu_usage", "gt", 80), ("r1", "cpu_usage", "gt", 90), ("r3", "disk", "gt", 1)), latest.latest_metrics(df))
    r = one(al.new_alerts(checked, stored(spark, ("a", "s", "cpu_usage", "acknowledged")), as_of()))
    assert (r["rule_id"], r["severity"], r["name"], r["labels"]) == ("r1", "medium", "Alert: rule r1", '{"a":"1"}')
    assert al.new_alerts(checked, stored(spark, ("a", "s", "cpu_usage", "active")), as_of()).count() == 0


def test_one_calm_rule_resolves_and_acknowledged_alerts_stay(spark):
    checked = al.rules_join_latest(
        rules(spark, ("r1", "cpu_usage", "gt", 90), ("r2", "cpu_usage", "gt", 99)), latest.latest_metrics(metrics(spark, ("s", "cpu_usage", 1, 95)))
    )
    before = stored(spark, ("a", "s", "cpu_usage", "active"), ("b", "s", "cpu_usage", "acknowledged"), ("c", "s", "disk", "active"))
    r = one(al.alerts_to_resolve(checked, before, as_of()))
    assert (r["id"], r["status"], r["resolved_at"]) == ("a", "resolved", AT)


def test_latest_with_limit_sees_the_first_name_only(spark):
    df = metrics(spark, ("s", "memory_usage", 1, 99), ("s", "cpu_usage", 9, 1))
    assert one(latest.latest_metrics(df, limit=1))["name"] == "cpu_usage"
    assert latest.latest_metrics(df).count() == 2


def test_latest_tie(spark):
    df = metrics(spark, ("s", "cpu_usage", 1, 1), ("s", "cpu_usage", 1, 2))
    assert one(latest.latest_metrics(df))["value"] == 2


def test_episodes(spark):
    df = metrics(spark, *[("s", "cpu_usage", 600 - 10 * i, v) for i, v in enumerate([5, 95, 96, 5, 97, 5, 5, 98])])
    r = rules(spark, ("r", "cpu_usage", "gt", 90)).withColumn("duration_s", F.lit(600))
    eps = al.alert_episodes(r, df)
    got = sorted((x["opened_at"], x["last_breach_at"], x["resolved_at"], x["peak"], x["n"]) for x in eps.select("*").collect() if x["resolved_at"])
    at = lambda i: AT - dt.timedelta(minutes=600 - 10 * i)
    assert got == [(at(1), at(2), at(3), 96.0, 2), (at(4), at(4), at(5), 97.0, 1)]
    assert eps.where("resolved_at IS NULL").first()["opened_at"] == at(7)
    assert one(al.alert_sustained(eps))["opened_at"] == at(1)


def test_availability_counts_overlaps_once(spark):
    h = lambda n: AT + dt.timedelta(hours=n)
    df = spark.createDataFrame(
        [("a", "s", h(0), h(5)), ("b", "s", h(1), h(2)), ("c", "s", h(4), h(8)), ("d", "s", h(20), h(30))],
        "id string, system_id string, created_at timestamp_ntz, resolved_at timestamp_ntz",
    )
    lit = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    r = one(al.availability(df, systems(spark, "s"), lit(h(0)), lit(h(24)), "hour"))
    assert r["outage_s"] == 12 * 3600 and r["availability"] == 0.5


def test_open_outages_run_to_the_end_and_calm_systems_are_there(spark):
    h = lambda n: AT + dt.timedelta(hours=n)
    df = spark.createDataFrame(
        [("a", "s", h(18), None), ("b", "s", h(20), h(22)), ("c", "s", h(30), None)],
        "id string, system_id string, created_at timestamp_ntz, resolved_at timestamp_ntz",
    )
    lit = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    got = al.availability(df, systems(spark, "s", "t"), lit(h(0)), lit(h(24)), "hour").collect()
    assert {r["system_id"]: (r["outage_s"], r["availability"]) for r in got} == {"s": (6 * 3600.0, 0.75), "t": (0.0, 1.0)}


def test_held_out_metrics():
    accuracy, precision, recall, f1 = learning.held_out_metrics({(0.0, 0.0): 6, (0.0, 1.0): 2, (1.0, 1.0): 1, (1.0, 0.0): 1})
    assert (accuracy, recall) == (0.7, pytest.approx(0.7))
    assert precision == pytest.approx(0.8 * 6 / 7 + 0.2 / 3)
    assert f1 == pytest.approx(0.8 * 0.8 + 0.2 * 0.4)
    assert learning.held_out_metrics({}) == (None,) * 4


def test_retraining_reports_failures_and_empty_tables(spark):
    fields = ", ".join(f"{c} double" for c in learning.FEATURES)
    none = spark.createDataFrame([], f"row_id string, label int, {fields}")
    from pyspark.ml.classification import LogisticRegression

    r = one(learning.retrain_all(none, {"m": LogisticRegression()}, "row_id"))
    assert (r["model_name"], r["status"]) == ("m", "failed") and r["error"]


def test_notifications(spark):
    df = spark.createDataFrame([("a", "email,slack,fax")], "id string, channels string")
    got = {(r["channel"], r["known"]) for r in al.notification_rows(df, "resolved", ["email"]).collect()}
    assert got == {("email", True), ("fax", False)}


# --- store ---------------------------------------------------------------------


def test_upsert_is_idempotent_and_ignores_label_order(spark):
    base = metrics(spark, ("s", "cpu_usage", 1, 1)).withColumn(
        "labels", labels.encode_labels(labels.decode_labels(F.lit('{"b":"2","a":"1"}'))))
    batch = metrics(spark, ("s", "cpu_usage", 1, 5), ("s", "cpu_usage", 1, 7)).withColumn("labels", F.lit('{"a":"1","b":"2"}')).withColumn("seq", F.col("id"))
    once = store.upsert_metrics(base, batch)
    assert one(once)["value"] == 7
    assert store.upsert_metrics(once, batch).collect() == once.collect()


def test_prom_body(spark):
    bodies = [("a", '{"status":"success","data":{"result":[{"metric":{"x":"y"},"value":[1706659200.1,"0.25"]}]}}'),
              ("b", '{"status":"success","data":{"result":[]}}'), ("c", '{"status":"error"}'), ("d", "oops"),
              ("e", '{"status":"success","data":{"result":[{"value":[1,"NaN!"]}]}}')]
    got = store.prom_response_rows(spark.createDataFrame(bodies, "k string, body string"))
    assert [(r["k"], r["value"]) for r in got.collect()] == [("a", 0.25)]


def test_matrix_splits_long_series_and_inverts(spark):
    df = metrics(spark, *[("s", "cpu_usage", 100 - i, i) for i in range(10)])
    matrix = store.prom_matrix(df, ["system_id", "name"], points_per_row=4)
    assert sorted(len(r["values"]) for r in matrix.collect()) == [2, 4, 4]
    back = store.prom_vector(matrix, ["system_id", "name"]).orderBy("time")
    assert [r["value"] for r in back.collect()] == [float(i) for i in range(10)]


def test_retention_keeps_the_boundary(spark):
    df = metrics(spark, ("s", "a", 30 * 1440, 1), ("s", "a", 30 * 1440 + 1, 1))
    assert store.retention_prune(df, as_of(), 30).count() == 1


def test_upsert_alert_clears_resolution(spark):
    a = spark.createDataFrame([("a", "resolved", AT, AT), ("b", "resolved", AT, AT)], "id string, status string, updated_at timestamp_ntz, resolved_at timestamp_ntz")
    got = {r["id"]: r["resolved_at"] for r in store.upsert_alerts(a, a.where("id = 'a'")).collect()}
    assert got == {"a": None, "b": AT}


# --- selection and validation -----------------------------------------------------


def test_range_rules(spark):
    df = metrics(spark, ("s", "a", 1, 1))
    start = dt.datetime(2024, 1, 1)
    selection.historical_checked(df, start, start + dt.timedelta(days=30, hours=23))
    with pytest.raises(ValueError):
        selection.historical_checked(df, start, start + dt.timedelta(days=31))
    with pytest.raises(ValueError):
        selection.historical_checked(df, start, start)
    with pytest.raises(ValueError):
        selection.span("soon")
    with pytest.raises(ValueError):
        selection.prediction_history(df, limit=1001)


def test_sql_text(spark):
    df = metrics(spark, ("s", "a", 1, 1), ("s", "a", 2, 3))
    assert one(selection.sql_query({"metrics": df}, "SELECT avg(value) AS m FROM {metrics}"))["m"] == 2


def test_failed_collectors_are_left_out(spark):
    df = metrics(spark, ("s", "a", 1, 1))
    got = store.collect_union({"x": df, "y": None, "z": df}, enabled=["x", "y"])
    assert [r["source"] for r in got.collect()] == ["x"]


def test_list_without_system_lists_all(spark):
    df = spark.createDataFrame([("a", "s", AT), ("b", "t", AT)], "id string, system_id string, created_at timestamp_ntz")
    assert selection.list_alerts(df).count() == 2
    assert selection.list_alerts(df, "s").count() == 1


def test_validation_splits_everything(spark):
    df = metrics(spark, ("s", "a", 1, 1), ("s", "", 1, 1), ("s", "b", -1, None))
    good, bad = validation.split_valid(validation.validate_metric_points(df, as_of()))
    assert good.count() == 1 and sorted(map(tuple, (r["reasons"] for r in bad.collect()))) == [
        ("no name",), ("timestamp in the future", "no value")]


# --- scoring ------------------------------------------------------------------------


def test_scores(spark):
    df = spark.createDataFrame([(0.3,), (0.99,), (0.29,), (0.8,)], "p double")
    got = df.select(scoring.failure_time(F.col("p"), as_of()), scoring.risk_level(F.col("p"))).collect()
    hours = [None if r[0] is None else (r[0] - AT).total_seconds() / 3600 for r in got]
    assert hours == [16, 1, None, 4] and [r[1] for r in got] == ["low", "critical", "low", "critical"]
    assert len(df.select(scoring.recommendations(F.lit(0.7))).first()[0]) == 3


def test_ensemble(spark):
    df = spark.createDataFrame([(1, "random_forest", 0.9, 0.8), (1, "lstm", 0.5, 0.5), (2, "other", 0.4, 0.0)],
                               "request_id long, model_name string, probability double, confidence double")
    got = {r["request_id"]: r for r in aggregate.ensemble_probability(df).collect()}
    assert got[1]["probability"] == pytest.approx(0.728571, abs=1e-6) and got[1]["confidence"] == pytest.approx(0.671429, abs=1e-6)
    assert got[2]["probability"] == 0


def test_weighted_confidence(spark):
    df = spark.createDataFrame([([0.8, 0.6],), ([],)], "c array<double>")
    got = [r["confidence"] for r in aggregate.weighted_confidence(df, "c").collect()]
    assert got[0] == pytest.approx(0.733333, abs=1e-6) and got[1] == 0


def test_model_score(spark):
    df = spark.createDataFrame([(0.85, 0.15, AT), (0.0, None, None), (1.0, 2.0, AT - dt.timedelta(days=45))],
                               "accuracy double, mae double, training_date timestamp_ntz")
    got = [r[0] for r in df.select(models.model_score(as_of(), F.lit(0.85))).collect()]
    assert got == pytest.approx([0.88, 0.085, 0.485])


def test_confidence_filter_with_and_without_bounds(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.9, 0.1, 0.85], [0.0, 1.0, 2.0], [2.0, 3.0, 4.0])],
                               "predictions array<double>, confidences array<double>, lower array<double>, upper array<double>")
    r = one(models.confidence_filter(df, 0.85))
    assert r["predictions"] == [1.0, 3.0] and r["lower"] == [0.0, 2.0]
    assert one(models.confidence_filter(df, 0.85, filter_bounds=False))["lower"] == [0.0, 1.0, 2.0]


def test_sequences(spark):
    df = metrics(spark, *[("s", "a", 10 - i, i) for i in range(5)])
    assert models.sequence_windows(df, ["system_id", "name"], 3).count() == 3
    assert models.sequence_windows(df, ["system_id", "name"], 6).count() == 0


def test_binary_and_logit(spark):
    r = spark.range(1).select(scoring.logit_probability(F.lit(0.0)).alias("l"), scoring.logit_probability(F.lit(-3.0)).alias("m")).first()
    assert (r["l"]["probability"], r["l"]["confidence"], r["m"]["confidence"]) == (0.5, 0.5, 1.0)


def test_features_are_fractions_and_zero_where_missing(spark):
    r = one(learning.features_wide(metrics(spark, ("s", "cpu_usage", 1, 95), ("s", "response_time", 1, 300))))
    assert (r["cpu_usage"], r["response_time"], r["memory_usage"]) == (0.95, 300, 0)


def test_constant_series_has_no_anomaly(spark):
    df = metrics(spark, *[("s", "a", 60 - i, 0.1) for i in range(30)], ("s", "a", 1, 0.1), ("t", "a", 1, 5))
    got = learning.anomaly_stat(df).collect()
    assert not any(r["is_anomaly"] for r in got) and {r["z"] for r in got} == {None}


def test_isolation_forest_finds_the_far_points(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(300)] + [(900 + i, 500.0 + 40 * i, -300.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = learning.isolation_score(df, ["x", "y"], "id", contamination=0.02, trees=30)
    flagged = {r["id"] for r in got.where("is_anomaly").collect()}
    assert flagged and flagged <= {900, 901, 902, 903, 904}
    again = learning.isolation_score(df.repartition(7), ["x", "y"], "id", contamination=0.02, trees=30)
    assert {r["id"] for r in again.where("is_anomaly").collect()} == flagged


# --- logs, histograms, events, remediation -------------------------------------------


def test_masking(spark):
    text = '{"Password":"x","list":[{"auth_header":1},2],"deep":{"n":{"my_token_id":null}},"ok":"é"}'
    got = spark.createDataFrame([(text,), ("plain",), (None,), ("3",)], "t string").select(masking.mask_json("t")).collect()
    assert [r[0] for r in got] == [
        '{"Password":"***MASKED***","list":[{"auth_header":"***MASKED***"},2],"deep":{"n":{"my_token_id":"***MASKED***"}},"ok":"é"}',
        "plain", None, "3"]
    df = spark.createDataFrame([Row(a=Row(token="t", n=1), l=[Row(secret="s")])])
    r = df.select(*[masking.mask_struct(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields]).first()
    assert r["a"]["token"] == masking.MASK and r["a"]["n"] == 1 and r["l"][0]["secret"] == masking.MASK


def test_log_entry_without_public_extras(spark):
    df = spark.createDataFrame([("m", {"_p": "1"}), ("m", {"q": "2", "_p": "1"})], "message string, x map<string,string>")
    got = [r["entry"] for r in logs.log_entry_json(df, ["message"], F.col("x")).collect()]
    assert got == ['{"message":"m"}', '{"message":"m","q":"2"}']


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (70.0,)], "v double")
    got = {r["le"]: r["cumulative"] for r in counters.histogram_cumulative(df, [], "v", counters.BUCKETS["prediction"]).collect()}
    assert got["0.1"] == 1 and got["0.5"] == 2 and got["60"] == 2 and got["+Inf"] == 3
    assert one(counters.quantile_hist(df, [], "v", counters.BUCKETS["prediction"], 1.0))["estimate"] == 60


def test_counter_reset(spark):
    df = metrics(spark, *[("s", "c", 10 - i, v) for i, v in enumerate([1, 5, 2, 4])])
    got = [r["increase"] for r in counters.counter_increase(df).orderBy("ts").collect()]
    assert got == [None, 4.0, 2.0, 2.0]
    assert one(counters.promql_rate(df, as_of(), "30m"))["rate"] == pytest.approx(8 / 180)


def test_late_and_sessions(spark):
    df = spark.createDataFrame(
        [(i, a, 1, AT + dt.timedelta(minutes=m), 1.0) for i, (a, m) in enumerate([(0, 0), (1, 10), (2, 4), (3, 40), (4, 9)])],
        "event_id long, arrival long, user_id long, ts timestamp_ntz, value double",
    )
    late = events.late_side_output(df, "arrival", 300, chunk=2).where("is_late").collect()
    assert [r["event_id"] for r in late] == [2, 4]
    got = sorted((r["n"], r["session_end"]) for r in events.sessions(df, "user_id", 1800).collect())
    assert got == [(1, AT + dt.timedelta(minutes=70)), (4, AT + dt.timedelta(minutes=40))]


def test_roi(spark):
    df = spark.createDataFrame([(8.0, 2000.0, 500000.0)], "downtime_hours double, staff_hours double, infra_savings double")
    assert one(remediation.roi_savings(df))["savings"] == 3_200_000


def test_retry(spark):
    df = spark.createDataFrame([("error", 0), ("error", 3), ("error", 4), ("success", 1)], "status string, attempts int")
    got = [(r["next"], r["delay_s"]) for r in events.retry_dead_letter(df).orderBy("attempts").collect()]
    assert got == [("retry", 1.0), ("retry", 8.0), ("dead-letter", None)]


def test_saved_forest_scores_by_sql(spark, tmp_path):
    """Probabilities recomputed by DuckDB from the written nodes."""
    import duckdb
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(2)
    rows = [(i, *[rng.gauss(0, 1) for _ in learning.FEATURES], i % 3 == 0 and 1 or 0) for i in range(300)]
    names = ", ".join(f"{c} double" for c in learning.FEATURES)
    train = spark.createDataFrame(rows, f"row_id long, {names}, label int").repartition(2)
    model = learning.train_random_forest(train, trees=7, depth=5)
    model.write().save(str(tmp_path / "model"))
    learning.forest_nodes(spark, str(tmp_path / "model")).write.parquet(str(tmp_path / "nodes"))
    train.write.parquet(str(tmp_path / "rows"))
    got = duckdb.connect().execute(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet' WHERE label = 1),
        x AS (SELECT row_id, [{", ".join(learning.FEATURES)}] AS f FROM '{tmp_path}/rows/*.parquet'),
        w AS (SELECT x.row_id, x.f, n.* FROM x JOIN n ON n.node = 0
          UNION ALL SELECT w.row_id, w.f, n.* FROM w JOIN n ON n.tree = w.tree
            AND n.node = CASE WHEN w.f[w.feature + 1] <= w.cut THEN w.lower ELSE w.upper END WHERE w.feature IS NOT NULL)
        SELECT row_id, avg(share) FROM w WHERE feature IS NULL GROUP BY 1""").fetchall()
    want = {
        r["row_id"]: r["p"] for r in model.transform(learning.assemble(train)).select("row_id", vector_to_array("probability")[1].alias("p")).collect()
    }
    assert len(got) == 300 and dict(got) == pytest.approx(want)
    assert len({round(p, 6) for p in want.values()}) > 20


def test_isolation_scores_by_sql(spark, tmp_path):
    """Scores recomputed by DuckDB from the written trees; every row is scored once."""
    import duckdb

    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 2)) for i in range(400)] + [(400, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    learning.grow_forest(df, ["x", "y"], "id", trees=9, subsample=64).write.parquet(str(tmp_path / "forest"))
    forest = spark.read.parquet(str(tmp_path / "forest"))
    learning.isolation_nodes(forest).write.parquet(str(tmp_path / "nodes"))
    df.write.parquet(str(tmp_path / "rows"))
    got = duckdb.connect().execute(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'),
        w AS (SELECT id, [x, y] AS f, n.* FROM '{tmp_path}/rows/*.parquet', n WHERE node = 0
          UNION ALL SELECT w.id, w.f, n.* FROM w JOIN n ON n.tree = w.tree
            AND n.node = CASE WHEN w.f[w.feature + 1] < w.cut THEN w.lower ELSE w.upper END WHERE w.feature IS NOT NULL),
        s AS (SELECT id, avg(path) AS path, max(size) AS size FROM w WHERE feature IS NULL GROUP BY 1)
        SELECT id, -power(2, -path / (2 * (ln(size - 1) + 0.5772156649) - 2 * (size - 1) / size)) FROM s""").fetchall()
    found = {r["id"]: r["score"] for r in learning.isolation_score(df, ["x", "y"], "id", forest=forest, trees=9, subsample=64).collect()}
    raw = dict(got)
    offset = raw[400] - found[400]
    assert len(found) == 401 and found == pytest.approx({i: v - offset for i, v in raw.items()})
    assert min(raw, key=raw.get) == 400
    assert sum(v < 0 for v in found.values()) == pytest.approx(40, abs=3)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_points_expand_the_grid_behind_the_join(spark):
    """The grid is no side of a join; null, repeated and unknown systems keep their hours."""
    df = metrics(spark, ("s", "cpu_usage", 30, 1), ("s", "cpu_usage", 31, 2), ("t", "cpu_usage", 0, 1), (None, "cpu_usage", 61, 1))
    got = counters.missing_points(df, systems(spark, "s", "s", "t", None), as_of(), 3)
    hours = [AT - dt.timedelta(hours=h) for h in (3, 2, 1)]
    want = [("s", h) for h in hours[:2]] * 2 + [("t", h) for h in hours] + [(None, h) for h in hours]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = optimized(got)
    assert plan.index("Generate") < plan.index("Join")


def test_instant_grid_points_meet_in_no_aggregation(spark):
    """Of samples of a step the newest answers, until the next answers or its lookback ends."""
    df = metrics(spark, ("s", "a", 21, 1), ("s", "a", 20, 2), ("s", "a", 12, 3), ("s", "a", 0, None), (None, "a", 12, 5))
    got = latest.instant_grid(df, 300, 900)
    at = {m: AT - dt.timedelta(minutes=m) for m in (20, 15, 10, 5, 0, -5, -10)}
    want = {("s", at[20], 2.0), ("s", at[15], 2.0), ("s", at[10], 3.0), ("s", at[5], 3.0)}
    want |= {("s", at[0], None), ("s", at[-5], None), ("s", at[-10], None), (None, at[10], 5.0), (None, at[5], 5.0), (None, at[0], 5.0)}
    assert {(r["system_id"], r["eval_time"], r["value"]) for r in got.collect()} == want
    assert got.count() == len(want)
    plan = optimized(got)
    assert "Aggregate" not in plan[:plan.index("Generate")]


def test_anomaly_statistics_do_not_deal_the_samples_by_series(spark):
    """A few series would be a few tasks; samples meet the statistics where they lie."""
    df = metrics(spark, ("s", "a", 30, 1), ("s", "a", 20, 3), ("s", "a", 10, 5), ("t", "a", 10, 5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of unknown, large size
    try:
        got = learning.anomaly_stat(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        counts = {r["id"]: r["n_before"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    assert counts == {0: 0, 1: 1, 2: 2, 3: 0}


def test_retraining_fits_the_scaler_once(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    fits, fit = [], StandardScaler._fit
    monkeypatch.setattr(StandardScaler, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    fields = ", ".join(f"{c} double" for c in learning.FEATURES)
    rows = [(f"r{i}", i % 2, *[float((i * 7 + k) % 5 + i % 2) for k in range(len(learning.FEATURES))]) for i in range(40)]
    data = spark.createDataFrame(rows, f"row_id string, label int, {fields}")
    got = learning.retrain_all(data, {"a": LogisticRegression(maxIter=2), "b": LogisticRegression(labelCol="none")}, "row_id").collect()
    assert [(r["model_name"], r["status"]) for r in got] == [("a", "success"), ("b", "failed")]
    assert len(fits) == 1
