"""Streaming jobs over several files, against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_semantics import RULES
from tidewatch.operators import events
from tidewatch.streaming import jobs

START = dt.datetime(2024, 1, 1)



def micros(ts):
    return (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of metric rows, one minute apart, in time order."""
    path = str(tmp_path / "in")
    for part in range(3):
        rows = [
            (part * 100 + i, "s", "cpu_usage", float((part * 100 + i) % 97), "percent", '{"a":"1"}',
             START + dt.timedelta(minutes=part * 100 + i))
            for i in range(100)
        ]
        df = spark.createDataFrame(rows, "id long, system_id string, name string, value double, unit string, labels string, ts timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, per_trigger=1):
    schema = spark.read.parquet(folder).schema
    return jobs.read_files(spark, folder, schema, per_trigger)


def test_closed_windows_equal_batch(spark, folder, tmp_path):
    got_df = jobs.tumbling_stream(stream(spark, folder), "30 minutes", "10 minutes")
    jobs.run_to_files(got_df, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["window_start"]: (r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = events.tumbling(spark.read.parquet(folder), ["name"], "30 minutes")
    want = {r["window_start"]: (r["n"], r["total"]) for r in batch.collect()}
    newest = START + dt.timedelta(minutes=299)
    closed = {k: v for k, v in want.items() if k + dt.timedelta(minutes=40) <= newest}
    assert got == closed and len(closed) >= 8


def test_collect_keeps_the_last_batch(spark, tmp_path):
    bodies = str(tmp_path / "in")
    point = '{"name":"cpu_usage","value":%d,"unit":"percent","labels":{"b":"2","a":"1"},"timestamp":"2024-01-01T00:00:00Z"}'
    for v in (1, 2, 3):
        text = '{"system_id":"s","metrics":[%s,%s]}' % (point % v, (point % (v * 10)).replace("cpu_usage", f"m{v}"))
        spark.createDataFrame([(text,)], "body string").coalesce(1).write.mode("append").parquet(bodies)
    table = jobs.BatchLog(spark, str(tmp_path / "log"))
    jobs.run_batches(stream(spark, bodies), jobs.collect_stream(table), str(tmp_path / "cp"))
    got = {r["name"]: r["value"] for r in jobs.collected_metrics(table).collect()}
    assert set(got) == {"cpu_usage", "m1", "m2", "m3"} and got["m3"] == 30
    # a batch that is run again changes nothing
    jobs.collect_stream(table)(spark.read.parquet(bodies).where(F.col("body").contains('"m3"')), 2)
    again = {r["name"]: r["value"] for r in jobs.collected_metrics(table).collect()}
    assert set(again) <= set(got) | {"m3"}


def test_alerts_open_and_resolve(spark, tmp_path):
    rules = spark.createDataFrame([("r", "s", "hot", "cpu_usage", "gt", 90.0, "high", None, "email")], RULES)
    state, changes = jobs.BoundedState(spark, str(tmp_path / "open")), jobs.BatchLog(spark, str(tmp_path / "changes"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    notices = jobs.BatchLog(spark, str(tmp_path / "notices"))
    step = jobs.alert_stream(state, changes, rules, at, jobs.BoundedState(spark, str(tmp_path / "points")), notices)

    def batch(value, minute):
        return spark.createDataFrame(
            [(minute, "s", "cpu_usage", float(value), "percent", None, START + dt.timedelta(minutes=minute))],
            "id long, system_id string, name string, value double, unit string, labels string, ts timestamp_ntz",
        )

    counts = []
    for number, value in enumerate([95, 96, 10, 99]):
        step(batch(value, number), number)
        counts.append(jobs.standing_alerts(changes).count())
    assert counts == [1, 1, 0, 1]
    log = [(r["batch"], r["status"]) for r in changes.read().orderBy("batch").collect()]
    assert log == [(0, "active"), (2, "resolved"), (3, "active")]
    step(batch(99, 3), 3)
    assert jobs.standing_alerts(changes).count() == 1 and changes.read().count() == 3
    said = [(r["batch"], r["type"], r["channel"]) for r in notices.read().orderBy("batch").collect()]
    assert said == [(0, "triggered", "email"), (2, "resolved", "email"), (3, "triggered", "email")]


def test_late_points_do_not_resolve(spark, tmp_path):
    """Batches in any order of time, against the rules on the newest point seen so far."""
    rules = spark.createDataFrame([
        ("r1", "s", "hot", "cpu_usage", "gt", 90.0, "high", None, "email,slack"), ("r2", "t", "hot", "cpu_usage", "gt", 50.0, None, None, "email"),
        ("r3", "u", "hot", "cpu_usage", "gt", 50.0, None, None, "email"),
    ], RULES)
    state, changes = jobs.BoundedState(spark, str(tmp_path / "open")), jobs.BatchLog(spark, str(tmp_path / "changes"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    step = jobs.alert_stream(state, changes, rules, at, jobs.BoundedState(spark, str(tmp_path / "points")))
    batches = [
        [(5, "s", 95.0), (5, "t", 40.0)], [(3, "s", 10.0), (6, "t", 60.0)], [(4, "t", 10.0)], [(7, "s", 20.0), (9, "x", 99.0)],
        [(6, "s", 99.0), (6, "t", 70.0)], [],
    ]
    newest, id_ = {}, 0
    for number, rows in enumerate(batches):
        table = []
        for minute, system, value in rows:
            id_ += 1
            table.append((id_, system, "cpu_usage", value, "percent", None, START + dt.timedelta(minutes=minute)))
            newest[system] = max(newest.get(system, (-1, 0, 0.0)), (minute, id_, value))
        schema = "id long, system_id string, name string, value double, unit string, labels string, ts timestamp_ntz"
        step(spark.createDataFrame(table, schema), number)
        want = {s for s, limit in (("s", 90), ("t", 50)) if s in newest and newest[s][2] > limit}
        assert {r["system_id"] for r in jobs.standing_alerts(changes).collect()} == want, number
    assert {r["channels"] for r in changes.read().where("status = 'active'").collect()} == {"email,slack", "email"}


def test_the_last_point_of_an_envelope_wins(spark, tmp_path):
    point = '{"name":"cpu_usage","value":%s,"timestamp":"2024-01-01T00:00:00Z"}'
    envelope = '{"system_id":"s","metrics":[%s,%s]}'
    rows = [(2, envelope % (point % 9, point % 1)), (1, envelope % (point % 8, point % 7)), (3, "{bad"), (4, None), (5, '{"metrics":[]}')]
    df = spark.createDataFrame(rows, "offset long, body string")
    for order, want in ((["offset"], 1.0), ([], 1.0)):
        table, rejects = jobs.BatchLog(spark, str(tmp_path / f"log{len(order)}")), jobs.BatchLog(spark, str(tmp_path / f"bad{len(order)}"))
        for _ in range(2):
            jobs.collect_stream(table, order=order, rejects=rejects)(df.repartition(3), 0)
            assert [(r["name"], r["value"]) for r in jobs.collected_metrics(table).collect()] == [("cpu_usage", want)]
        reasons = {r["offset"]: r["reason"] for r in rejects.read().collect()}
        assert reasons == {3: "malformed body", 4: "no body", 5: "no system_id"}


def test_a_batch_delivered_twice_is_stored_once(spark, tmp_path):
    from tidewatch.sources import files

    rows = [(i, "s", "cpu_usage" if i % 9 else None, float(i), START + dt.timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, system_id string, name string, value double, ts timestamp_ntz")
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tasks are merged
    try:
        for part, batch in ((df.where("id < 200"), "a"), (df.where("id >= 200"), "b"), (df.where("id < 200"), "a")):
            files.write_metrics(part, path, batch, rows_per_file=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = files.read_metrics(spark, path)
    assert sorted(r["id"] for r in got.collect()) == list(range(300))
    files_of_one = {r["f"] for r in got.where("batch = 'a' AND name = 'cpu_usage'").select(F.input_file_name().alias("f")).collect()}
    assert 1 < len(files_of_one) <= 4


def test_routes(spark, tmp_path):
    rows = [(1, "metrics", '{"k": 1}'), (2, "bogus", '{"k": 1}'), (3, "logs", "{bad")]
    spark.createDataFrame(rows, "id long, topic string, body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    table = jobs.BatchLog(spark, str(tmp_path / "out"))
    jobs.run_batches(stream(spark, str(tmp_path / "in")), jobs.route_stream(table), str(tmp_path / "cp"))
    assert {(r["id"], r["route"]) for r in table.read().collect()} == {(1, "metrics"), (2, "dead-letter"), (3, "dead-letter")}


def test_closed_sessions_equal_batch(spark, tmp_path):
    minutes = [0, 5, 50, 52, 54, 200, 400]
    rows = [(i, 7, START + dt.timedelta(minutes=m), 1.0) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = events.sessions_streaming(jobs.event_time(stream(spark, str(tmp_path / "in"))), "user_id", "30 minutes")
    jobs.run_to_files(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["session_start"], r["session_end"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = events.sessions(df, "user_id", 1800).collect()
    want = sorted((r["session_start"], r["session_end"], r["n"]) for r in batch)
    assert got == want[:-1] and len(want) == 4


def test_dedup_within_watermark(spark, tmp_path):
    rows = [(k, START + dt.timedelta(minutes=m)) for k, m in [("a", 0), ("a", 1), ("b", 2)]]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    df = jobs.dedup_stream(stream(spark, str(tmp_path / "in")), ["k"], "1 hour")
    jobs.run_to_files(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


@pytest.mark.parametrize("per_trigger", [1, 5])
def test_expiring_counts_go_by_event_time(spark, tmp_path, per_trigger):
    """Files in and out of order, without keys and times, in several batches or one, against plain Python."""
    rng = random.Random(21)
    rows, path = [], str(tmp_path / "in")
    for part in range(5):
        some = [
            (rng.choice(["hot", "hot", "hot", "b", None]),
             None if rng.random() < 0.05 else START + dt.timedelta(minutes=part * 200 + rng.randint(-20, 200), microseconds=rng.randint(0, 9)))
            for _ in range(60)
        ]
        rows += some
        spark.createDataFrame(some, "user string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    table = jobs.BatchLog(spark, str(tmp_path / "log"))
    counts = jobs.expiring_counts(stream(spark, path, per_trigger), "user", ttl_seconds=900, delay="60 minutes")
    jobs.run_stateful(counts, table.write, str(tmp_path / "cp"))
    got = sorted((str(r["key"]), r["first_us"], r["last_us"], r["n"]) for r in table.read().collect())
    newest = max(ts for _, ts in rows if ts)
    want = []
    for key in {k for k, _ in rows}:
        pieces = []
        for ts in sorted(ts for k, ts in rows if k == key and ts):
            if pieces and ts - pieces[-1][-1] < dt.timedelta(seconds=900):
                pieces[-1].append(ts)
            else:
                pieces.append([ts])
        want += [(str(key), micros(p[0]), micros(p[-1]), len(p)) for p in pieces if p[-1] + dt.timedelta(minutes=76) <= newest]
    sure = [w for w in want if w[2] + 76 * 60_000_000 <= micros(newest)]
    assert [g for g in got if g in sure] == sorted(sure) and len(sure) > 20
    assert all(g[2] + 74 * 60_000_000 <= micros(newest) for g in got)


def test_stretches_join():
    assert jobs.merged_stretches([(10, 12, 2), (0, 1, 1), (3, 8, 4)], 3) == [(0, 12, 7)]
    assert jobs.merged_stretches([(10, 12, 2), (0, 1, 1), (4, 7, 4)], 3) == [(0, 1, 1), (4, 7, 4), (10, 12, 2)]
    assert jobs.merged_stretches([], 3) == []
