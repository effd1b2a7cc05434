"""Repeated ids in a batch, unknown values, offsets and NaN."""

import datetime as dt
import random

from pyspark.sql import functions as F, types as T

from tidewatch.functions import masking
from tidewatch.operators import ordered, quantiles, remediation, selection, store

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_last_of_a_batch_wins(spark):
    systems = spark.createDataFrame([("a", "old", None)], "id string, name string, created_at timestamp_ntz")
    batch = spark.createDataFrame(
        [("a", "first", None, 2), ("a", "last", None, 3_000_000_000), ("b", "x", None, 1)],
        "id string, name string, created_at timestamp_ntz, seq long",
    )
    got = {r["id"]: r["name"] for r in store.upsert_systems(systems, batch).collect()}
    assert got == {"a": "last", "b": "x"} and store.upsert_systems(systems, batch).count() == 2


def test_second_acknowledgement_is_an_error(spark):
    alerts = spark.createDataFrame([("a", "active")], "id string, status string")
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    got = sorted(str(r["error"]) for r in store.acknowledge_alerts(alerts, ids, as_of()).collect())
    assert got == ["None", "alert is not in active state"]


def test_gate_is_closed_for_unknown_actions(spark):
    actions = spark.createDataFrame([(1, "s", None, "prod"), (2, "s", "restart", None), (3, "s", "restart", "dev")],
                                    "action_id long, system_id string, action_type string, environment string")
    latest = spark.createDataFrame([], "system_id string, name string, value double")
    got = {r["action_id"]: r["allowed"] for r in remediation.safety_gate(actions, latest, ["prod"]).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_bounds_with_an_offset(spark):
    metrics = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS ts, 's' AS system_id UNION ALL SELECT timestamp_ntz'2024-01-01 12:00:00', 's'")
    got = selection.historical_metrics(metrics, as_of(), "2024-01-01T11:59:00+02:00", "2024-01-01T12:01:00+02:00").collect()
    assert [r["ts"].hour for r in got] == [10]


def test_errors_and_audit_are_topics(spark):
    messages = spark.createDataFrame([("errors", '{"k": 1}'), ("audit", '{"k": 1}'), ("bogus", '{"k": 1}')], "topic string, body string")
    got = {r["topic"]: r["route"] for r in store.topic_route(messages).collect()}
    assert got == {"errors": "errors", "audit": "audit", "bogus": "dead-letter"}


def test_percentiles_leave_nan_out(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in range(1, 11)] + [("k", float("nan"))] * 6, "k string, v double")
    assert quantiles.exact_percentiles(rows, ["k"], "v", {"p50": 0.5}).first()["p50"] == 5.5


def test_maps_of_other_values_are_masked(spark):
    df = spark.sql("SELECT map('api_key', 42, 'n', 1) AS m, map('a', map('token', 't', 'x', 'y')) AS d")
    out = df.select(*[masking.mask_struct(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert out["m"] == {"api_key": None, "n": 1} and out["d"] == {"a": {"token": masking.MASK, "x": "y"}}
    assert isinstance(df.schema["m"].dataType, T.MapType)


def test_deep_json_is_masked_as_a_whole(spark):
    deep = "[" * 200_000 + "1" + "]" * 200_000
    got = [r["t"] for r in spark.createDataFrame([(deep,), ('{"token":"x","a":1}',)], "t string").select(masking.mask_json("t").alias("t")).collect()]
    assert got == [masking.MASK, '{"token":"%s","a":1}' % masking.MASK]


def test_downsample_reads_once_and_keeps_each_retention(spark):
    """Every aggregator at three resolutions, limits inside windows, and NaN, against plain Python."""
    as_of = dt.datetime(2024, 1, 31, 5, 20)
    rng = random.Random(1)
    rows = []
    for i in range(600):
        value = rng.choice([float("nan"), None, *[float(rng.randint(-9, 9)) for _ in range(8)]])
        rows.append((i, rng.choice("st"), "m", value, as_of - dt.timedelta(minutes=rng.randint(0, 4 * 24 * 60))))
    df = spark.createDataFrame(rows, "id long, system_id string, name string, value double, ts timestamp_ntz")
    rules = [(r, d, a) for r, d in (("90 minutes", 1), ("1 hour", 2), ("1 day", 3)) for a in store.AGGREGATORS]
    got = {}
    out = store.downsample(df, rules, F.lit(as_of.isoformat(" ")).cast("timestamp_ntz"))
    for r in out.collect():
        got[r["resolution"], r["aggregator"], r["system_id"], r["window_start"]] = r["value"]
    want = {}
    for resolution, days, aggregator in rules:
        size = store.resolution_seconds(resolution)
        groups = {}
        for i, s, _, v, ts in rows:
            if ts >= as_of - dt.timedelta(days=days):
                us = (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1)
                groups.setdefault((s, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=us - us % size)), []).append((ts, i, v))
        for (s, start), group in groups.items():
            values = [v for _, _, v in group if v is not None and v == v]
            known = [(ts, i, v) for ts, i, v in group if v is None or v == v]
            want[resolution, aggregator, s, start] = {
                "avg": sum(values) / len(values) if values else None, "min": min(values, default=None), "max": max(values, default=None),
                "sum": sum(values) if values else None, "count": float(len(values)), "last": max(known, key=lambda r: r[:2])[2] if known else None,
            }[aggregator]
    assert got == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
