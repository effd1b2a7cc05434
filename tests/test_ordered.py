"""Chunked scans against plain Python, with chunks small enough to matter."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import chunks, ordered, quantiles

START = dt.datetime(2024, 1, 1)


def rows(n=400, keys=("a", "b", None), seed=3, skew=0.7):
    """A third key is null and one key holds most rows; times repeat."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = keys[0] if rng.random() < skew else rng.choice(keys)
        value = None if rng.random() < 0.15 else float(rng.randint(-20, 20))
        out.append((i, key, START + dt.timedelta(minutes=rng.randint(0, 3000)), value))
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, ts timestamp_ntz, v double").repartition(4)


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_running(frame, data):
    got = ordered.running(
        frame, ["k"], ["ts", "id"], ordered.time_chunk("ts"),
        prev=ordered.previous(F.col("v")), total=ordered.running_sum(F.col("v")),
        top=ordered.running_max(F.col("v")), before=ordered.max_before(F.col("v")),
        known=ordered.last_known(F.col("v")), no=ordered.row_number(), whole=ordered.total_sum(F.col("v")),
    )
    want = {}
    for group in by_key(data).values():
        seen, whole = [], [r[3] for r in group if r[3] is not None]
        for i, r in enumerate(group):
            earlier = [x for x in seen if x is not None]
            seen.append(r[3])
            upto = [x for x in seen if x is not None]
            want[r[0]] = (
                group[i - 1][3] if i else None, sum(upto) if upto else None, max(upto, default=None),
                max(earlier, default=None), upto[-1] if upto else None, i + 1, sum(whole) if whole else None,
            )
    result = {r["id"]: (r["prev"], r["total"], r["top"], r["before"], r["known"], r["no"], r["whole"]) for r in got.collect()}
    assert result == want


def test_running_without_key(frame, data):
    got = ordered.running(frame, [], ["ts", "id"], ordered.time_chunk("ts"), no=ordered.row_number())
    order = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["no"])] == order


def _islands(data, gap):
    out = []
    for key, group in by_key(data).items():
        last = None
        for r in group:
            if last is None or r[2] - last > gap:
                out.append([key, r[2], r[2], 0, 0.0])
            out[-1][2] = r[2]
            out[-1][3] += 1
            out[-1][4] += r[3] or 0.0
            last = r[2]
    return sorted((tuple(x) for x in out), key=repr)


@pytest.mark.parametrize("minutes", [5, 30, 90, 400, 4000])
@pytest.mark.parametrize("chunk", ["hour", "day"])
def test_island_aggregates(frame, data, minutes, chunk):
    """Islands inside a chunk, over many chunks, and over whole empty chunks."""
    apart = F.timestamp_diff("SECOND", F.col("before"), F.col("ts")) > minutes * 60
    got = ordered.island_aggregates(
        frame, ["k"], ["ts", "id"], ordered.time_chunk("ts", chunk), {"before": F.col("ts")},
        F.col("before").isNull() | apart,
        a=("min", F.col("ts")), b=("max", F.col("ts")), n=("count", F.col("id")),
        total=("sum", F.coalesce("v", F.lit(0.0))),
    )
    result = sorted(((r["k"], r["a"], r["b"], r["n"], r["total"]) for r in got.collect()), key=repr)
    assert result == _islands(data, dt.timedelta(minutes=minutes))


def test_islands_numbered(frame, data):
    apart = F.timestamp_diff("SECOND", F.col("before"), F.col("ts")) > 1800
    got = ordered.islands(
        frame, ["k"], ["ts", "id"], ordered.time_chunk("ts"), {"before": F.col("ts")},
        F.col("before").isNull() | apart,
    ).groupBy("k", "island").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("id").alias("n"))
    result = sorted(((r["k"], r["a"], r["b"], r["n"]) for r in got.collect()), key=repr)
    assert result == [x[:4] for x in _islands(data, dt.timedelta(minutes=30))]


def test_island_rows_before_the_first_start(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (9, 0)], "t long, s int")
    got = ordered.island_aggregates(
        df, [], ["t"], ordered.number_chunk("t", 2), {"p": F.col("s")}, F.col("s") == 1,
        first=("min", F.col("t")), n=("count", F.col("t")),
    )
    assert [tuple(r) for r in got.collect()] == [(3, 3)]


@pytest.mark.parametrize("size,halo", [(7, 7), (10, 3), (50, 9), (1000, 20)])
def test_blocks(frame, data, size, halo):
    from pyspark.sql.window import Window

    cut = ordered.blocks(frame, ["k"], ["ts", "id"], ordered.time_chunk("ts"), halo, size)
    back = Window.partitionBy("k", "block").orderBy("row_no").rowsBetween(-halo, 0)
    got = cut.select("id", "is_halo", F.collect_list("id").over(back).alias("ids")).where(~F.col("is_halo"))
    want = {}
    for group in by_key(data).values():
        for i, r in enumerate(group):
            want[r[0]] = [x[0] for x in group[max(0, i - halo): i + 1]]
    assert {r["id"]: list(r["ids"]) for r in got.collect()} == want


@pytest.mark.parametrize("now", [True, False])
def test_trailing_sums(frame, data, now):
    span = dt.timedelta(hours=3)
    got = ordered.trailing_sums(frame, ["k"], "ts", 3 * 3600, now, n=F.lit(1), total=F.coalesce("v", F.lit(0.0)))
    want = {}
    for group in by_key(data).values():
        for r in group:
            inside = [x for x in group if r[2] - span <= x[2] and (x[2] <= r[2] if now else x[2] < r[2])]
            want[r[0]] = (len(inside), sum(x[3] or 0.0 for x in inside))
    assert {r["id"]: (r["n"] or 0, r["total"] or 0.0) for r in got.collect()} == want


def test_trailing_sums_at_the_exact_edge(spark):
    times = [START + dt.timedelta(seconds=s) for s in (0, 3600, 3601, 7200, 10_800, 10_801)]
    df = spark.createDataFrame(list(enumerate(times)), "id long, ts timestamp_ntz")
    got = ordered.trailing_sums(df, [], "ts", 3600, True, n=F.lit(1))
    assert [r["n"] for r in got.orderBy("id").collect()] == [1, 2, 2, 3, 2, 2]


@pytest.mark.parametrize("buffered", [0, 60, 10**6])
def test_exact_percentiles(frame, data, buffered, monkeypatch):
    monkeypatch.setattr(quantiles, "BUFFERED_ROWS", buffered)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = quantiles.exact_percentiles(frame, ["k"], "v", shares)
    for r in got.collect():
        values = [x[3] for x in data if x[1] == r["k"] and x[3] is not None]
        for name, q in shares.items():
            assert r[name] == pytest.approx(np.percentile(values, 100 * q))


@pytest.mark.parametrize("buffered", [0, 10**6])
def test_percentiles_of_wide_and_tiny_values(spark, buffered, monkeypatch):
    monkeypatch.setattr(quantiles, "BUFFERED_ROWS", buffered)
    values = [0.0, -0.5, 1e-9, 2e-9, 1e12, -1e12, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = quantiles.exact_percentiles(df, [], "v", {"q": 0.3, "m": 0.5}).first()
    assert r["q"] == pytest.approx(np.percentile(values, 30)) and r["m"] == np.percentile(values, 50)


@pytest.mark.parametrize("low, step", [(0.0, 1e-6), (1e9, 1.0), (-5.0, 1e-3)])
def test_no_chunk_of_values_holds_more_than_its_bound(spark, low, step):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.lit(low) + F.col("id") * step).alias("v"))
    cut = chunks.with_chunks(df, ["k"], chunks.value_chunks("v", 300), "r")
    sizes = cut.groupBy("r").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
    assert max(r["n"] for r in sizes) <= 300
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    assert quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5}).first()["m"] == pytest.approx(low + 9999.5 * step)


def skewed_times(spark, n=12_000):
    """One key holds most rows: half of them in one hour, of these half in one second, and some at one instant."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        kind = rng.random()
        key = "hot" if kind < 0.8 else rng.choice(["a", None])
        us = rng.choice([rng.randrange(10**11), 7 * 3_600_000_000 + rng.randrange(3_600_000_000), 7 * 3_600_000_000 + rng.randrange(10**6), 5])
        rows.append((i, key, START + dt.timedelta(microseconds=us), float(rng.randint(-9, 9))))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double").repartition(4), rows


@pytest.mark.parametrize("bound", [1, 50, 400])
def test_no_chunk_of_time_holds_more_than_its_bound(spark, bound):
    """But for rows of one instant, which stay together."""
    df, _ = skewed_times(spark)
    cut = chunks.with_chunks(df, ["k"], chunks.row_chunks("ts", bound), "c")
    assert set(cut.columns) == {*df.columns, "c"} and cut.count() == df.count()
    sizes = cut.groupBy("k", "c").agg(F.count("ts").alias("n"), F.count_distinct("ts").alias("times"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    sizes = sizes.orderBy("k", "c").collect()
    assert all(r["n"] <= bound or r["times"] == 1 for r in sizes)
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]) if a["k"] == b["k"])


@pytest.mark.parametrize("most", [0, 1_000])
def test_dense_cells_are_joined_when_too_many_to_broadcast(spark, most, monkeypatch):
    monkeypatch.setattr(chunks, "BROADCAST_CELLS", most)
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", most)
    monkeypatch.setattr(quantiles, "BUFFERED_ROWS", 100)
    df, rows = skewed_times(spark, 3000)
    cut = chunks.with_chunks(df, ["k"], chunks.row_chunks("ts", 20), "c")
    sizes = cut.groupBy("k", "c").agg(F.count("ts").alias("n"), F.count_distinct("ts").alias("times")).collect()
    assert all(r["n"] <= 20 or r["times"] == 1 for r in sizes) and sum(r["n"] for r in sizes) == 3000
    got = {r["k"]: r["m"] for r in quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {k: np.median([r[3] for r in rows if r[1] == k]) for k in ("hot", "a", None)}


@pytest.mark.parametrize("bound", [3, 100, 10**6])
def test_scans_do_not_depend_on_the_bound(spark, bound):
    df, rows = skewed_times(spark, 3000)
    got = ordered.running(
        df, ["k"], ["ts", "id"], ordered.row_chunks("ts", bound), no=ordered.row_number(), total=ordered.running_sum(F.col("v")),
        before=ordered.previous(F.col("id")),
    )
    want = {}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            want[r[0]] = (i + 1, sum(x[3] for x in group[:i + 1]), group[i - 1][0] if i else None)
    assert {r["id"]: (r["no"], r["total"], r["before"]) for r in got.collect()} == want


@pytest.mark.parametrize("bound", [3, 10**6])
@pytest.mark.parametrize("now", [True, False])
def test_trailing_sums_do_not_depend_on_the_bound(spark, bound, now):
    df, rows = skewed_times(spark, 1200)
    span = dt.timedelta(hours=2)
    got = ordered.trailing_sums(df, ["k"], "ts", 7200, now, rows=bound, n=F.lit(1), total=F.col("v"))
    want = {}
    for group in by_key(rows).values():
        for r in group:
            inside = [x[3] for x in group if r[2] - span <= x[2] and (x[2] <= r[2] if now else x[2] < r[2])]
            want[r[0]] = (len(inside), sum(inside))
    assert {r["id"]: (r["n"] or 0, r["total"] or 0.0) for r in got.collect()} == want


@pytest.mark.parametrize("buffered", [0, 100, 10**6])
def test_moments_leave_nan_out(spark, buffered, monkeypatch):
    """Whether the values of all, one or no key meet in a buffer."""
    monkeypatch.setattr(quantiles, "BUFFERED_ROWS", buffered)
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(50, 3, 500), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", float("nan")), ("a", None), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r for r in quantiles.exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p90": 0.9}, moments=True).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        want = [len(v), v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, [10, 90])]
        assert [got[k][c] for c in ("n", "mean", "std", "min", "max", "p10", "p90")] == pytest.approx(want)


@pytest.mark.parametrize("buffered", [0, 10**6])
def test_percentiles_with_infinities(spark, buffered, monkeypatch):
    monkeypatch.setattr(quantiles, "BUFFERED_ROWS", buffered)
    values = [float("-inf"), -1.0, 0.0, 2.0, float("inf"), float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = quantiles.exact_percentiles(df, [], "v", {"lo": 0.0, "m": 0.5, "hi": 0.9}).first()
    assert (r["lo"], r["m"], r["hi"]) == (float("-inf"), 2.0, float("inf"))


def test_ranges_of_null_keys_and_few_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k string, ts timestamp_ntz, v double")
    chunk = ordered.time_chunk("ts")
    assert ordered.running(df, ["k"], ["ts", "id"], chunk, n=ordered.row_number()).count() == 0
    assert quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5}).count() == 0


def test_rows_are_shuffled_once_and_never_by_key_alone(frame):
    """The plan over the rows has one exchange, on the key and the chunk."""
    got = ordered.running(frame, ["k"], ["ts", "id"], ordered.time_chunk("ts"), p=ordered.previous(F.col("v")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "__chunk" in plan
