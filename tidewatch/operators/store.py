"""Reading, merging and maintaining the monitoring tables.

A merge is an aggregate (``max_by`` combines before the shuffle) or one
equi-join; the result is a new version of the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.labels import decode_labels, encode_labels, utc_timestamp
from tidewatch.operators import ordered

METRIC_KEY = ("system_id", "name", "ts", "labels")

# Stream topics, and the processor that takes each record type.
TOPICS = ("metrics", "logs", "events", "traces", "alerts", "errors", "audit", "dead-letter")
PROCESSED_TOPICS = ("metrics", "logs", "events", "traces", "alerts", "errors", "audit")


def scan_metrics(df: DataFrame) -> DataFrame:
    """Typed metric rows with the labels decoded."""
    return df.withColumn("labels", decode_labels(F.col("labels")))


ENVELOPE = (
    "system_id string, metrics array<struct<name:string, value:double, unit:string, "
    "labels:map<string,string>, timestamp:string>>"
)


def collect_points(bodies: DataFrame, body: str = "body", order: Sequence[str] = ()) -> DataFrame:
    """Metric rows of JSON envelopes, with ``seq``: their place among all points, to settle equal keys by.

    ``order`` names the columns that say which envelope came first (an offset, an arrival time).  Envelopes
    that tie, or carry no order, are ordered by their text, so that a batch read again settles the same.
    """
    place = F.struct(*order, F.col(body).alias("body"), "position")
    parsed = bodies.select(body, *order, F.from_json(body, ENVELOPE).alias("e"))
    return parsed.select(body, *order, "e.system_id", F.posexplode("e.metrics").alias("position", "m")).select(
        "system_id", "m.name", "m.value", "m.unit",
        encode_labels(F.col("m.labels")).alias("labels"),
        utc_timestamp(F.col("m.timestamp")).alias("ts"), place.alias("seq"),
    )


def ingest_collect(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON envelopes to metric rows; the envelope's system wins over any in a point.

    Envelopes that give no rows are those of :func:`rejected_envelopes`, and those with an empty list.
    """
    return collect_points(bodies, body).drop("seq")


def rejected_envelopes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The rows whose envelope is refused, with the ``reason``: nothing is dropped in silence."""
    corrupt = "_corrupt"
    parsed = bodies.withColumn("__e", F.from_json(
        body, f"{ENVELOPE}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    ))
    e = F.col("__e")
    reason = (
        F.when(F.col(body).isNull() | (F.trim(body) == ""), "no body")
        .when(e.isNull() | e[corrupt].isNotNull(), "malformed body")
        .when(F.coalesce(e["system_id"], F.lit("")) == "", "no system_id")
        .when(e["metrics"].isNull(), "no metrics")
    )
    return parsed.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__e")


def settle_points(points: DataFrame) -> DataFrame:
    """One row for each metric key: value and unit of the last by ``seq``."""
    last = F.max_by(F.struct("value", "unit"), "seq").alias("w")
    return points.groupBy(*METRIC_KEY).agg(last).select(*METRIC_KEY, "w.value", "w.unit")


def upsert_metrics(target: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert ``batch``; on an equal key the last of the batch replaces value and unit."""
    columns = [*METRIC_KEY, "value", "unit"]
    old = target.select(*columns, F.lit(-1).cast("long").alias("__seq"))
    new = batch.select(*columns, F.col(seq).cast("long").alias("__seq"))
    winner = F.max_by(F.struct("value", "unit"), "__seq")
    return (
        old.unionByName(new).groupBy(*METRIC_KEY).agg(winner.alias("w"))
        .select(*METRIC_KEY, "w.value", "w.unit")
    )


def _last_of_each(batch: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the last by ``seq`` where the batch has that column, else the greatest row."""
    rest = [c for c in batch.columns if c not in (key, "seq")]
    order = F.struct(*(["seq"] if "seq" in batch.columns else []), *rest)
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__w")) if rest else batch.select(key).distinct()
    return last.select(key, *[F.col("__w")[c].alias(c) for c in rest])


def _merge(target: DataFrame, batch: DataFrame, key: str, pick) -> DataFrame:
    """Full outer merge on ``key``; ``pick(column, old, new)`` gives each column.

    A key that the batch repeats counts once (see ``_last_of_each``).
    """
    batch = _last_of_each(batch, key)
    old = target.select(*[F.col(c).alias(f"o_{c}") for c in target.columns])
    new = batch.select(*[F.col(c).alias(f"n_{c}") for c in batch.columns])
    joined = old.join(new, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    columns = []
    for c in target.columns:
        incoming = F.col(f"n_{c}") if c in batch.columns else F.lit(None)
        value = F.coalesce(f"o_{key}", f"n_{key}") if c == key else pick(c, F.col(f"o_{c}"), incoming)
        columns.append(value.alias(c))
    return joined.select(*columns)


def upsert_systems(systems: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or overwrite everything but ``created_at``."""
    arrived = F.col("n_id").isNotNull()

    def pick(column: str, old: Column, new: Column) -> Column:
        if column == "created_at":
            return F.when(F.col("o_id").isNotNull(), old).otherwise(new)
        return F.when(arrived, new).otherwise(old)

    return _merge(systems, batch, "id", pick)


def upsert_alerts(alerts: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert, or overwrite status and ``updated_at``; ``resolved_at`` becomes null.

    Stored rows touched by the batch lose ``resolved_at``: the insert carries no
    such column, so neither new nor overwritten rows have one.
    """
    arrived, stored = F.col("n_id").isNotNull(), F.col("o_id").isNotNull()

    def pick(column: str, old: Column, new: Column) -> Column:
        if column == "resolved_at":
            return F.when(~arrived, old)
        if column in ("status", "updated_at"):
            return F.when(arrived, new).otherwise(old)
        return F.when(stored, old).otherwise(new)

    return _merge(alerts, batch, "id", pick)


def upsert_rules(rules: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Create or replace rules; the stored ``created_at`` stays when the update lacks one."""
    arrived = F.col("n_id").isNotNull()

    def pick(column: str, old: Column, new: Column) -> Column:
        if column == "created_at":
            return F.when(arrived, F.coalesce(new, old, as_of)).otherwise(old)
        if column == "updated_at":
            return F.when(arrived, as_of).otherwise(old)
        return F.when(arrived, new).otherwise(old)

    return _merge(rules, batch, "id", pick)


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("enabled"))


def _patch(df: DataFrame, patches: DataFrame, set_columns: dict[str, Column]) -> DataFrame:
    patches = _last_of_each(patches)
    p = patches.select(*[F.col(c).alias(f"p_{c}") for c in patches.columns])
    joined = df.join(p, F.col("id") == F.col("p_id"), "left")
    hit = F.col("p_id").isNotNull()
    kept = [c for c in df.columns if c not in set_columns]
    patched = []
    for name, value in set_columns.items():
        old = F.col(name) if name in df.columns else F.lit(None)
        patched.append(F.when(hit, value).otherwise(old).alias(name))
    return joined.select(*kept, *patched)


def _unless_empty(new: str, old: str) -> Column:
    return F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))


def update_system_partial(systems: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Apply patches of name, description, tags and thresholds.

    An empty text, a null list or map, and a column the patches do not have leave the stored value;
    a patch of a column the systems do not have is ignored.
    """
    changes = {c: _unless_empty(f"p_{c}", c) for c in ("name", "description")}
    changes |= {c: F.coalesce(f"p_{c}", c) for c in ("tags", "thresholds")}
    known = {c: v for c, v in changes.items() if c in systems.columns and c in patches.columns}
    return _patch(systems, patches, {**known, "updated_at": as_of})


def update_alert(alerts: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Patch status and description; status ``resolved`` stamps ``resolved_at``."""
    resolving = F.col("p_status") == "resolved"
    return _patch(
        alerts, patches,
        {
            "status": _unless_empty("p_status", "status"),
            "description": _unless_empty("p_description", "description"),
            "resolved_at": F.when(resolving, as_of).otherwise(F.col("resolved_at")),
            "updated_at": as_of,
        },
    )


def acknowledge_alerts(alerts: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Outcome of each requested acknowledgement; only active alerts change, and only once."""
    times = ids.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    found = times.select("id", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k")).join(
        alerts.select("id", F.col("status").alias("__old")), "id", "left"
    )
    active = (F.col("__old") == "active") & (F.col("__k") == 1)
    return found.select(
        "id",
        F.when(F.col("__old") == "active", "acknowledged").otherwise(F.col("__old")).alias("status"),
        F.when(active, as_of).alias("updated_at"),
        F.when(F.col("__old").isNull(), "alert not found")
        .when(~active, "alert is not in active state").alias("error"),
    )


def delete_system_cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove systems and everything that refers to them."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    out = {}
    for name, df in tables.items():
        key = "id" if name == "systems" else "system_id"
        out[name] = df.join(gone, F.col(key) == F.col("__gone"), "left_anti")
    return out


def delete_alert(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    return alerts.join(ids.select("id"), "id", "left_anti")


def collect_union(sources: dict[str, DataFrame | None], enabled: Sequence[str] | None = None) -> DataFrame:
    """Points of all enabled collectors, tagged by source; a failed one (None) is left out."""
    tagged = [
        df.select("system_id", "name", "value", "unit", "ts").withColumn("source", F.lit(name))
        for name, df in sources.items()
        if df is not None and (enabled is None or name in enabled)
    ]
    return reduce(DataFrame.unionByName, tagged)


def collector_status(runs: DataFrame) -> DataFrame:
    """Per source: points stored, errors, last run and last error.

    ``runs`` has ``source``, ``ts``, ``points`` and ``error`` (null when fine).
    """
    failed = F.col("error").isNotNull()
    return runs.groupBy("source").agg(
        F.sum("points").alias("metrics_count"),
        F.count_if(failed).alias("error_count"),
        F.max("ts").alias("last_collection"),
        F.max_by("error", F.when(failed, F.struct("ts", "error"))).alias("last_error"),
    )


PROM_BODY = "status string, data struct<result:array<struct<metric:map<string,string>, value:array<string>>>>"


def prom_response_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """First sample of each successful query response, as a double."""
    parsed = bodies.withColumn("__r", F.from_json(body, PROM_BODY))
    sample = F.get(F.get(F.col("__r.data.result"), F.lit(0))["value"], F.lit(1))
    return (
        parsed.where(F.col("__r.status") == "success")
        .withColumn("value", sample.try_cast("double"))
        .where(F.col("value").isNotNull())
        .drop("__r", body)
    )


def prom_matrix(
    vector: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value",
    tie: str = "id", points_per_row: int = 11_000,
) -> DataFrame:
    """Samples to series rows holding ordered ``[time, value]`` pairs.

    A series longer than ``points_per_row`` (the most a query server returns for
    one series) continues in further rows numbered by ``part``.
    """
    numbered = ordered.running(
        vector, keys, [ts, tie], ordered.row_chunks(ts), __n=ordered.row_number()
    )
    part = F.floor((F.col("__n") - 1) / F.lit(points_per_row)).cast("long")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col(ts).alias("time"), F.col(value).alias("value"))))
    return (
        numbered.withColumn("part", part).groupBy(*keys, "part")
        .agg(F.transform(pairs, lambda p: F.struct(p["time"], p["value"])).alias("values"))
    )


def prom_vector(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series rows back to one row per sample."""
    return matrix.select(*keys, F.explode("values").alias("v")).select(*keys, "v.time", "v.value")


def parse_records(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Parse JSON bodies; rows that do not parse keep ``reason``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("record", F.from_json(body, f"{schema}, _corrupt string", options))
    bad = F.col("record._corrupt").isNotNull() | F.col("record").isNull()
    return parsed.withColumn("reason", F.when(bad, "malformed body"))


def topic_route(messages: DataFrame, schema: str = "k long") -> DataFrame:
    """Topic each record goes to; unknown or unparsable records go to the dead letters."""
    parsed = parse_records(messages, schema)
    known = F.col("topic").isin(*PROCESSED_TOPICS)
    routed = F.when(known & F.col("reason").isNull(), F.col("topic")).otherwise("dead-letter")
    return parsed.withColumn("route", routed).drop("record", "reason")


def dead_letter(messages: DataFrame, schema: str = "k long") -> DataFrame:
    """Records that cannot be processed, with the reason."""
    parsed = parse_records(messages, schema)
    reason = F.coalesce(
        F.col("reason"), F.when(~F.col("topic").isin(*PROCESSED_TOPICS), "unknown topic")
    )
    return parsed.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("record")


def retention_prune(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; the boundary itself is kept."""
    return metrics.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


#: How each aggregator reads the state merged for a window.
AGGREGATORS = {
    "avg": lambda: F.sum("__sum") / F.sum("__n"),
    "min": lambda: F.min("__min"),
    "max": lambda: F.max("__max"),
    "sum": lambda: F.sum("__sum"),
    "count": lambda: F.sum("__n").cast("double"),
    "last": lambda: F.max(F.struct("__last.ts", "__last.id", "__last.value"))["value"],
}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def resolution_seconds(text: str) -> int:
    """Seconds of a resolution such as ``5 minutes``."""
    number, unit = text.split()
    return int(number) * UNITS[unit.lower().rstrip("s")]


def downsample(
    metrics: DataFrame, rules: Sequence[tuple[str, int, str]], as_of: Column
) -> DataFrame:
    """Apply ``(resolution, retention days, aggregator)`` rules and union the results.

    The points are read once, whatever the number of rules: they are first reduced to states that
    can be merged (sum, count, least, greatest, last), one for each series, step of the finest common
    resolution, and side of the retention limits; each rule merges the states it keeps.  NaN is left out.
    """
    ts_type = metrics.schema["ts"].dataType.simpleString()
    zero = F.lit("1970-01-01 00:00:00" + ("" if ts_type == "timestamp_ntz" else " UTC")).cast(ts_type)
    seconds = [resolution_seconds(r) for r, _, _ in rules]
    step = math.gcd(*seconds) * 1_000_000
    limits = sorted({int(days) for _, days, _ in rules})
    age = F.lit(0)
    for days in limits:
        age = age + F.when(F.col("ts") < as_of - F.expr(f"INTERVAL {days} DAYS"), 1).otherwise(0)
    known = F.when(~F.isnan("value"), F.col("value"))
    at = F.timestamp_diff("MICROSECOND", zero, F.col("ts"))
    states = (
        retention_prune(metrics, as_of, limits[-1])
        .withColumns({"__at": at - F.pmod(at, F.lit(step)), "__age": age})
        .groupBy("system_id", "name", "__at", "__age").agg(
            F.sum(known).alias("__sum"), F.count(known).alias("__n"), F.min(known).alias("__min"), F.max(known).alias("__max"),
            F.max(F.when(~F.isnan("value") | F.col("value").isNull(), F.struct("ts", "id", "value"))).alias("__last"),
        )
    )
    # a rule keeps the states on its side of its own limit
    kept = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("rule"), F.lit(limits.index(int(days))).alias("oldest"), (F.col("__at") - F.pmod("__at", F.lit(size * 1_000_000))).alias("start"))
            for i, ((_, days, _), size) in enumerate(zip(rules, seconds))
        ]),
        lambda r: r["oldest"] >= F.col("__age"),
    )
    merged = states.withColumn("__r", F.explode(kept)).groupBy("system_id", "name", "__r.rule", "__r.start").agg(
        *[AGGREGATORS[a]().alias(f"__v_{a}") for a in sorted({a for _, _, a in rules})]
    )

    def of_rule(values: Sequence[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("rule") + 1)

    return merged.select(
        of_rule([F.lit(r) for r, _, _ in rules]).alias("resolution"), of_rule([F.lit(a) for _, _, a in rules]).alias("aggregator"),
        "system_id", "name", F.timestamp_add("MICROSECOND", F.col("start"), zero).alias("window_start"),
        of_rule([F.col(f"__v_{a}") for _, _, a in rules]).alias("value"),
    )
