"""Decisions in order, against a straightforward replay."""

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sequential

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    """Bursts with pauses; one client sends most of the requests."""
    rng = random.Random(5)
    rows, now = [], {}
    for i in range(1500):
        client = "hot" if rng.random() < 0.6 else rng.choice(["a", "b"])
        pause = rng.choice([0, 0.2, 0.5, 1, 3, 90]) if rng.random() < 0.98 else 200
        now[client] = now.get(client, 0) + pause
        path = rng.choice(["/x", "/y"])
        rows.append((i, client, path, START + dt.timedelta(seconds=now[client]), 5 if path == "/x" else 20))
    return rows


@pytest.fixture(scope="module")
def frame(spark, log):
    return spark.createDataFrame(log, "request_id long, client string, path string, ts timestamp_ntz, rate_limit int").repartition(6)


def test_sliding_log(frame, log):
    accepted, want = {}, {}
    for i, client, path, ts, limit in sorted(log, key=lambda r: (r[3], r[0])):
        recent = [t for t in accepted.get((client, path), []) if t > ts - dt.timedelta(seconds=60)]
        want[i] = len(recent) < limit
        accepted[(client, path)] = recent + ([ts] if want[i] else [])
    got = {r["request_id"]: r["accepted"] for r in sequential.rate_limit_sliding(frame).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_token_bucket(frame, log):
    state, want = {}, {}
    for i, client, _, ts, _ in sorted(log, key=lambda r: (r[3], r[0])):
        tokens, before = state.get(client, (Fraction(5), ts))
        tokens = min(Fraction(5), tokens + Fraction((ts - before) // dt.timedelta(microseconds=1), 2_000_000))
        want[i] = tokens >= 1
        state[client] = (tokens - want[i], ts)
    got = {r["request_id"]: r["accepted"] for r in sequential.rate_limit_bucket(frame, 30, 5).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("seconds,chunk", [(10, None), (10, 15), (10, 40), (3, 100), (60, 61), (400, 100)])
def test_keep_spaced(frame, log, seconds, chunk):
    """Chunks longer and shorter than the spacing."""
    last, want = {}, {}
    for i, client, _, ts, _ in sorted(log, key=lambda r: (r[3], r[0])):
        want[i] = client not in last or ts - last[client] >= dt.timedelta(seconds=seconds)
        if want[i]:
            last[client] = ts
    df = sequential.keep_spaced(frame, ["client"], "ts", "request_id", seconds, chunk_seconds=chunk)
    got = {r["request_id"]: r["kept"] for r in df.collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_keep_spaced_with_null_keys(spark):
    rows = [(1, None, "a", START), (2, "a", None, START), (3, None, "a", START)]
    df = spark.createDataFrame(rows, "id long, x string, y string, ts timestamp_ntz")
    got = sequential.keep_spaced(df, ["x", "y"], "ts", "id", 60).where("kept").collect()
    assert sorted(r["id"] for r in got) == [1, 2]


def test_wide_integers_survive(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, 1, START), (big + 2, None, START)], "id long, n long, ts timestamp_ntz")
    got = sequential.keep_spaced(df, ["n"], "ts", "id", 60).collect()
    assert {(r["id"], r["n"]) for r in got} == {(big, 1), (big + 2, None)}


def replay_sliding(rows, seconds):
    """Plain replay of (id, client, path, ts, limit)."""
    accepted, want = {}, {}
    for i, client, path, ts, limit in sorted(rows, key=lambda r: (r[3], r[0])):
        recent = [t for t in accepted.get((client, path), []) if t > ts - dt.timedelta(seconds=seconds)]
        want[i] = limit is None or len(recent) < limit
        accepted[(client, path)] = recent + ([ts] if want[i] else [])
    return want


REQUESTS = "request_id long, client string, path string, ts timestamp_ntz, rate_limit int"


def steady(n, mean, seed, limit, bursts=0):
    """A client that never pauses for long, with ``bursts`` stretches of overload."""
    rng = random.Random(seed)
    rows, now = [], 0.0
    hot = [rng.randrange(n) for _ in range(bursts)]
    for i in range(n):
        fast = any(0 <= i - h < 40 for h in hot)
        now += round(rng.uniform(0, 2 * mean) * (0.1 if fast else 1), 3)
        rows.append((i, "hot", "/x", START + dt.timedelta(seconds=now), limit))
    return rows


@pytest.mark.parametrize("mean,limit,seconds,windows,bursts", [
    (1.0, 20, 10, 2, 6), (0.5, 20, 10, 2, 0), (0.6, 20, 10, 4, 3), (1.0, 15, 10, 3, 10),
])
def test_sliding_log_of_a_key_without_pauses(spark, mean, limit, seconds, windows, bursts):
    rows = steady(1200, mean, 3, limit, bursts)
    rows += [(5000 + i, None, "/x", ts, None if i % 7 == 0 else limit) for i, _, _, ts, _ in rows[:200]]
    df = spark.createDataFrame(rows, REQUESTS).repartition(5)
    got = sequential.rate_limit_sliding(df, window_seconds=seconds, windows=windows)
    assert got.columns == [*df.columns, "accepted"]
    found = [(r["request_id"], r["accepted"]) for r in got.collect()]
    assert len(found) == len(rows) and dict(found) == replay_sliding(rows, seconds)


def test_calm_keys_are_split(spark):
    """A client that never pauses, with a third of the limit: no piece is longer than two cuts apart."""
    rows = steady(3000, 1.0, 4, 30)
    df = spark.createDataFrame(rows, REQUESTS)
    cut = sequential.calm_segments(df, ["client", "path"], "ts", "rate_limit", 10, windows=4)
    sizes = [r["n"] for r in cut.groupBy(sequential.SEGMENT).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 120
    assert cut.where(~F.col(sequential.WARM)).count() == 3000


@pytest.mark.parametrize("mean,burst,bursts", [(2.0, 5, 0), (1.2, 5, 8), (0.9, 3, 0), (1.0, 1, 2)])
@pytest.mark.parametrize("rows_per_chunk", [None, 50])
def test_token_bucket_of_a_key_without_pauses(spark, mean, burst, bursts, rows_per_chunk):
    rows = steady(1000, mean, 6, 0, bursts)
    state, want = None, {}
    for i, _, _, ts, _ in rows:
        tokens, before = state or (Fraction(burst), ts)
        tokens = min(Fraction(burst), tokens + Fraction((ts - before) // dt.timedelta(microseconds=1), 1_000_000))
        want[i] = tokens >= 1
        state = (tokens - want[i], ts)
    df = spark.createDataFrame(rows, REQUESTS).repartition(5)
    got = sequential.rate_limit_bucket(df, 60, burst, rows_per_chunk)
    assert {r["request_id"]: r["accepted"] for r in got.collect()} == want
    if mean == 2.0:
        cut = sequential.full_segments(df, ["client"], "ts", "request_id", 60, rows_per_chunk)
        sizes = [r["count"] for r in cut.groupBy(sequential.SEGMENT).count().collect()]
        assert len(sizes) > 200 and max(sizes) < 60


def test_rate_limits_of_rows_without_time_and_empty_tables(spark):
    rows = [(1, "a", "/x", None, 5), (2, "a", "/x", START, 5), (3, None, None, START, 0)]
    df = spark.createDataFrame(rows, REQUESTS)
    assert {r["request_id"]: r["accepted"] for r in sequential.rate_limit_sliding(df).collect()} == {1: False, 2: True, 3: False}
    assert {r["request_id"]: r["accepted"] for r in sequential.rate_limit_bucket(df, 60, 2).collect()} == {1: False, 2: True, 3: True}
    assert sequential.rate_limit_sliding(df.limit(0)).count() == sequential.rate_limit_bucket(df.limit(0), 60, 2).count() == 0


def test_suppression_rules_share_one_pass(spark):
    """Three rules of different times, first match first, and alerts without a rule, against plain Python."""
    rng = random.Random(8)
    names = ["cpu_usage", "error_rate", "disk"]
    rows = [
        (i, rng.choice("ab"), rng.choice(names), rng.choice(["low", "high"]), START + dt.timedelta(seconds=rng.randint(0, 200_000)))
        for i in range(900)
    ]
    rules = [("^cpu", 7200, "low"), ("cpu", 600, None), ("rate", 50_000, None)]
    df = spark.createDataFrame(rows, "id long, system_id string, metric_name string, severity string, created_at timestamp_ntz")
    out = sequential.alert_suppress(df.repartition(3), rules)
    want, last = {}, {}
    for i, s, m, severity, at in sorted(rows, key=lambda r: (r[4], r[0])):
        rule = next((k for k, (p, _, c) in enumerate(rules) if p.strip("^") in m and c in (None, severity)), None)
        key = (s, m, rule)
        want[i] = rule is None or key not in last or at - last[key] >= dt.timedelta(seconds=rules[rule][1])
        if want[i]:
            last[key] = at
    assert {r["id"]: r["kept"] for r in out.collect()} == want
    assert out.columns == [*df.columns, "kept"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    assert all(r["kept"] for r in sequential.alert_suppress(df, []).collect())
