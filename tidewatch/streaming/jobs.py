"""Structured Streaming jobs around the batch operators.

State that outlives a micro-batch is kept in Spark's state store, in an
append-only log with a folder per batch, or, where its size is bounded, in a
small table written anew by each batch.  In every case a batch that is run again
after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import TimestampNTZType

from tidewatch.functions.times import to_instant
from tidewatch.operators import alerts as al, counters, events, store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Stream parquet files; ``path`` is a folder or a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark needs an instant; wall-clock times are taken as UTC."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        df = df.withColumn(ts, to_instant(F.col(ts)))
    return df.withWatermark(ts, delay)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; closed results are appended to ``path``."""
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_stateful(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """``run_batches`` for queries with state of their own, which need RocksDB and may only append."""
    spark = df.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        query = (
            df.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


# --- windows and rates ------------------------------------------------------


def tumbling_stream(metrics: DataFrame, size: str, max_out_of_order: str) -> DataFrame:
    return events.tumbling(event_time(metrics, delay=max_out_of_order), ["name"], size)


def throughput_stream(messages: DataFrame, delay: str = "1 minute") -> DataFrame:
    return counters.throughput(event_time(messages, delay=delay))


def dedup_stream(df: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    return event_time(df, delay=ttl).dropDuplicatesWithinWatermark(keys)


# --- tables written by micro-batches ------------------------------------------


class BatchLog:
    """Append-only table: batch N owns the folder ``batch=N``.

    A batch costs what it carries, whatever the table has grown to, and a batch
    that runs again overwrites only its own folder.  Rows with equal keys are
    settled when the table is read.  The table belongs to one checkpoint: batch
    numbers begin again when the checkpoint is removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


class BoundedState:
    """A small table of which batch N writes the whole of version N.

    Meant for state bounded by something other than the stream, such as the open
    alert of each rule.  Batch N reads version N - 1, so running N again gives
    the same result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def before(self, batch: int) -> DataFrame | None:
        return self.at(batch - 1) if batch else None

    def at(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={batch}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")


def collect_stream(
    table: BatchLog, body: str = "body", order: Sequence[str] = (), rejects: BatchLog | None = None,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: points of JSON envelopes appended to the metric log.

    Of points of one batch with the same key the last wins: by ``order`` (columns that say which
    envelope came first), then by their place in the envelope.  A batch run again writes the same.
    With ``rejects``, refused envelopes and their reasons are logged there.
    """

    def step(batch: DataFrame, number: int) -> None:
        table.write(store.settle_points(store.collect_points(batch, body, order)), number)
        if rejects is not None:
            rejects.write(store.rejected_envelopes(batch, body), number)

    return step


def route_stream(table: BatchLog, schema: str = "k long") -> Callable[[DataFrame, int], None]:
    """Micro-batch step: records fanned out by topic, a folder for each route.

    One pass writes all routes, dead letters included.
    """

    def step(batch: DataFrame, number: int) -> None:
        store.topic_route(batch, schema).write.mode("overwrite").partitionBy("route").parquet(
            f"{table.path}/batch={number}"
        )

    return step


def collected_metrics(table: BatchLog) -> DataFrame:
    """The metric table the log stands for: the last batch wins on equal keys."""
    log = table.read()
    return store.upsert_metrics(log.limit(0), log, seq="batch")


ALERT_COLUMNS = (
    "id", "rule_id", "system_id", "metric_name", "severity", "status", "created_at", "updated_at", "resolved_at", "channels",
)


POINT_COLUMNS = ("system_id", "name", "id", "value", "unit", "labels", "ts")


def newest_points(points: BoundedState, rules: DataFrame, batch: DataFrame, number: int) -> DataFrame:
    """The newest point so far of each system and metric that some rule watches; kept as version ``number``.

    The state is bounded by the rules.  Points are ordered by time and id, so a late one changes nothing.
    """
    watched = rules.select("system_id", F.col("metric_name").alias("name")).distinct()
    seen = batch.select(*POINT_COLUMNS).join(watched, ["system_id", "name"], "left_semi")
    before = points.before(number)
    seen = seen if before is None else before.select(*POINT_COLUMNS).unionByName(seen)
    last = F.max_by(F.struct("id", "value", "unit", "labels", "ts"), F.struct("ts", "id")).alias("p")
    points.write(seen.groupBy("system_id", "name").agg(last).select("system_id", "name", "p.*"), number)
    return points.at(number)


def alert_stream(
    open_alerts: BoundedState, changes: BatchLog, rules: DataFrame, at: Column, points: BoundedState,
    notices: BatchLog | None = None, enabled: Sequence[str] = al.CHANNELS,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: evaluate the rules on the newest points so far, open and resolve alerts.

    Kept are the newest points of watched metrics, the open alerts, at most one per system and metric, and a
    log of every opening and resolution; a late point neither opens nor resolves.  With ``notices``, each
    opening and resolution is logged there once for every enabled channel.  Rules that trigger are
    handled before rules that are calm, so both read the same evaluation.
    """

    def step(batch: DataFrame, number: int) -> None:
        checked = al.rules_join_latest(rules, newest_points(points, rules, batch, number)).persist()
        none = F.lit(None).cast("timestamp_ntz")
        current = open_alerts.before(number)
        if current is None:
            current = al.alert_project(checked.limit(0), at).withColumn("resolved_at", none).select(*ALERT_COLUMNS)
        opened = al.new_alerts(checked, current, at).withColumn("resolved_at", none).select(*ALERT_COLUMNS)
        standing = current.unionByName(opened)
        resolved = al.alerts_to_resolve(checked, standing, at).select(*ALERT_COLUMNS)
        changes.write(opened.unionByName(resolved), number)
        if notices is not None:
            said = [al.notification_rows(df, kind, enabled) for df, kind in ((opened, "triggered"), (resolved, "resolved"))]
            notices.write(said[0].unionByName(said[1]), number)
        open_alerts.write(standing.join(resolved.select("id"), "id", "left_anti").select(*ALERT_COLUMNS), number)
        checked.unpersist()

    return step


def standing_alerts(changes: BatchLog) -> DataFrame:
    """The open alerts the log of changes stands for."""
    last = F.max_by("status", F.struct("batch", (F.col("status") == "resolved").alias("end")))
    return (
        changes.read().groupBy("id", "rule_id", "system_id", "metric_name", "severity")
        .agg(last.alias("status"), F.min("created_at").alias("created_at")).where(F.col("status") == "active")
    )


# --- state with a time to live ----------------------------------------------


def merged_stretches(pieces: list[tuple[int, int, int]], ttl: int) -> list[tuple[int, int, int]]:
    """``(first, last, n)`` in order of time, where pieces less than ``ttl`` apart have become one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(pieces):
        if out and first - out[-1][1] < ttl:
            begun, end, held = out.pop()
            first, last, n = begun, max(end, last), held + n
        out.append((first, last, n))
    return out


class ExpiringCount(StatefulProcessor):
    """Counts of a key that expire when event time has gone on by the TTL since their last row.

    The state is the stretches of time that may still grow; late rows can join two of them.  They do not
    overlap, so the first ends first: one timer a key, for that one, and what the watermark has passed is put out.
    """

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "first long, last long, n long")

    def _due(self, last: int) -> int:
        return -(-(last + self.ttl) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(map(int, piece)) for piece in self._open.get()] if self._open.exists() else []
        pieces = list(before)
        for part in rows:
            pieces += zip(part["first"].tolist(), part["last_us"].tolist(), part["n"].tolist())
        now = merged_stretches(pieces, self.ttl)
        self._open.put(now)
        due, set_before = self._due(now[0][1]), self._due(before[0][1]) if before else None
        if due != set_before:
            if set_before is not None:
                self._handle.deleteTimer(set_before)
            self._handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(map(int, piece)) for piece in self._open.get()] if self._open.exists() else []
        over = [piece for piece in held if self._due(piece[1]) <= at]
        left = [piece for piece in held if self._due(piece[1]) > at]
        if left:
            self._open.put(left)
            self._handle.registerTimer(self._due(left[0][1]))
        else:
            self._open.clear()
        if over:
            yield pd.DataFrame({
                "key": [None if key[0] is None else str(key[0])] * len(over), "first_us": [p[0] for p in over],
                "last_us": [p[1] for p in over], "n": [p[2] for p in over],
            })

    def close(self) -> None:
        pass


def expiring_counts(df: DataFrame, key: str, ts: str = "ts", ttl_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """``key, first_us, last_us, n``: counts per key that start anew after ``ttl_seconds`` without a row.

    Time is that of the rows, so a backlog gives the same counts in one batch or many, and state goes as
    the watermark passes, not by the clock.  Rows are joined to stretches inside each Arrow batch first: a busy
    key sends a few rows per ten thousand to its state rather than all of them.  Rows without a time are left out;
    rows without a key are one key.
    """
    ttl = ttl_seconds * 1_000_000
    stamp = F.col(ts)
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        stamp = to_instant(stamp)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["key", "us"], na_position="first", ignore_index=True)
            other = (batch["key"] != batch["key"].shift()) & ~(batch["key"].isna() & batch["key"].shift().isna())
            begins = other | (batch["us"] - batch["us"].shift() >= ttl)
            if len(begins):
                begins.iloc[0] = True
            runs = batch.groupby(begins.cumsum())
            out = runs.agg(key=("key", lambda k: k.iloc[0]), first=("us", "min"), last_us=("us", "max"), n=("us", "size"))
            out["last"] = pd.to_datetime(out["last_us"], unit="us", utc=True)
            yield out[["key", "first", "last_us", "last", "n"]]

    rows = df.select(F.col(key).cast("string").alias("key"), F.unix_micros(stamp).alias("us")).where(F.col("us").isNotNull())
    runs = rows.mapInPandas(combine, "key string, first long, last_us long, last timestamp, n long")
    return runs.withWatermark("last", delay).groupBy("key").transformWithStateInPandas(
        statefulProcessor=ExpiringCount(ttl), outputStructType="key string, first_us long, last_us long, n long",
        outputMode="Append", timeMode="EventTime",
    )
