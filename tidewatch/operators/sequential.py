"""Decisions that depend on earlier decisions: spacing and rate limits.

Spacing (``keep_spaced``: suppression, TTL duplicates) remembers one time, the
last kept one.  What a chunk of a key does to that time can be tabulated without
knowing it, so chunks run in parallel and only the small tables are read in order.

A rate limit remembers as many times as it allows requests, which cannot be
tabulated.  Two things keep it from becoming one task per key:

* A key is cut wherever the state can be proven without knowing the decisions
  before: where all requests of the last window were surely accepted
  (``calm_segments``), or where the bucket is full even if every request
  before had paid (``full_segments``).  The pieces are independent and are spread
  over the cluster.  A key need not pause for that, it must only not be overloaded all the time.
* Inside a piece the rows are streamed from a sorted partition in Arrow batches.
  The state is the few accepted times that still count, never the rows.

What remains serial is a stretch of one key in which it is overloaded without a
break; it is read at streaming speed in constant memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.operators import ordered
from tidewatch.operators.chunks import same

SEGMENT, WARM = "__segment", "__warm"
#: Units of a token.
TOKEN = 60_000_000
NEVER = -(2**62)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def calm_segments(
    df: DataFrame, keys: Sequence[str], ts: str, limit: str, window_seconds: float, parts: int = 8, windows: int = 64
) -> DataFrame:
    """Cut each key where the requests of the last window were all accepted, whatever came before.

    Requests are counted in buckets of a ``parts``-th of the window.  Where the bucket of a request and
    the ``parts`` before it hold no more than the limit, the request is accepted.  After ``parts`` such
    buckets the accepted times that still count are simply the requests of these buckets.  The first
    such place in every ``windows`` (2 at least) windows is a cut.  ``SEGMENT`` numbers the pieces; each is preceded
    by copies (``WARM``) of the rows of the window before it.  All this is found from
    the counts of (key, bucket), in chunks of ``parts * windows`` of them; only the table of cuts, one row a chunk, is ordered by key.
    """
    if windows < 2:
        raise ValueError("cuts must be two windows apart at least")
    keys = list(keys)
    step = -(-int(window_seconds * 1_000_000) // parts)
    size, b = parts * windows, F.col("__bucket")
    at = df.withColumn("__bucket", F.floor(_micros(ts) / F.lit(step))).withColumn("__chunk", F.floor(b / F.lit(size)))
    counts = at.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("n"), F.min(limit).alias("least"))
    # the last buckets of a chunk also lead the next one, so that windows need not leave a chunk
    copies = F.when(F.pmod(b, F.lit(size)) >= size - 2 * parts, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    led = counts.withColumn("__k", F.explode(copies)).withColumn("__chunk", F.floor(b / F.lit(size)) + F.col("__k"))
    near = Window.partitionBy(*keys, "__chunk").orderBy("__bucket")
    held = led.withColumn("held", F.sum("n").over(near.rangeBetween(-parts, 0)))
    busy = F.coalesce(F.col("held") > F.col("least"), F.lit(False))
    spoilt = F.coalesce(F.max(busy).over(near.rangeBetween(-parts, -1)), F.lit(False))
    cuts = held.withColumn("spoilt", spoilt).where("__k = 0").groupBy(*keys, "__chunk").agg(F.min(F.when(~F.col("spoilt"), b)).alias("__cut"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    cuts = cuts.withColumns({
        "__before": F.last("__cut", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "__after": F.lead("__cut").over(order),
    })
    by = [*keys, "__chunk"]
    table = cuts.select(*[F.col(c).alias(f"__d_{c}") for c in by], "__cut", "__before", "__after")
    own = F.coalesce(F.when(b >= F.col("__cut"), F.col("__cut")), F.col("__before"), F.lit(NEVER))

    def ahead(cut: Column) -> Column:
        return F.when((b < cut) & (b >= cut - parts), cut)

    places = F.array(
        F.struct(own.alias("s"), F.lit(False).alias("w")),
        *[F.struct(ahead(F.col(c)).alias("s"), F.lit(True).alias("w")) for c in ("__cut", "__after")],
    )
    placed = at.join(table, same(by, "__d_"), "left").withColumn("__place", F.explode(F.filter(places, lambda p: p["s"].isNotNull())))
    return placed.select(*df.columns, F.col("__place.s").alias(SEGMENT), F.col("__place.w").alias(WARM))


def full_segments(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, per_minute: int, rows: int | None = None
) -> DataFrame:
    """Cut each key where its bucket is full even if every request before had paid.

    Were all ``i - 1`` requests before paid, the debt before request ``i`` is zero exactly where
    ``per_minute * time - (i - 1) * token`` is at least as large as at every request before.  So the
    running maximum of that is constant between two such places and names the pieces.
    """
    numbered = ordered.running(df, keys, [ts, tie], ordered.row_chunks(ts, rows), __no=ordered.row_number())
    wide = "decimal(20,0)"
    surplus = _micros(ts).cast(wide) * F.lit(per_minute) - (F.col("__no") - 1).cast(wide) * F.lit(TOKEN)
    out = ordered.running(numbered, keys, [ts, tie], ordered.row_chunks(ts, rows), **{SEGMENT: ordered.running_max(surplus)})
    return out.drop("__no").withColumn(WARM, F.lit(False))


def _with_marks(batch: pa.RecordBatch, columns: Sequence[str], name: str, marks: list[bool]) -> pa.RecordBatch:
    """The columns as they are, with the decisions.

    Arrow columns pass through untouched; in pandas, integers next to nulls would
    become floats.
    """
    arrays = [batch.column(c) for c in columns] + [pa.array(marks, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, [*columns, name])


def _schema_with(df: DataFrame, name: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` boolean"])


def decide_in_order(
    cut: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str, tie: str,
    make_decider: Callable[[], Callable[[int, object], bool]], name: str = "accepted", parameter: str | None = None,
) -> DataFrame:
    """The ``columns`` and a boolean decided row by row, in time order, within each segment of a key.

    ``make_decider()`` returns a function from microseconds and the row's ``parameter`` to the decision; it is
    made anew for each segment.  ``WARM`` rows are decided but not returned.  Rows without a time are refused.
    """
    columns = list(columns)
    keyed = cut.withColumn("__us", _micros(ts)).withColumn("__key", F.to_json(F.struct(*keys, SEGMENT)))
    laid = keyed.repartition("__key").sortWithinPartitions("__key", ts, tie)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, decider = None, None
        for batch in batches:
            marks = []
            given = batch.column(parameter).to_pylist() if parameter else [None] * len(batch)
            for key, us, value in zip(batch.column("__key").to_pylist(), batch.column("__us").to_pylist(), given):
                if key != current:
                    current, decider = key, make_decider()
                marks.append(us is not None and decider(us, value))
            marked = _with_marks(batch, columns, name, marks)
            yield marked.filter(pc.invert(batch.column(WARM)))

    return laid.mapInArrow(decide, _schema_with(cut.select(*columns), name))


def sliding_log(window_us: int) -> Callable[[int, int | None], bool]:
    """Accept while fewer than the row's limit of accepted times lie in the window before; no limit accepts."""
    accepted: deque[int] = deque()

    def decider(us: int, limit: int | None) -> bool:
        while accepted and accepted[0] <= us - window_us:
            accepted.popleft()
        if limit is not None and len(accepted) >= limit:
            return False
        accepted.append(us)
        return True

    return decider


def token_bucket(per_minute: int, burst: int) -> Callable[[int, object], bool]:
    """A bucket that starts full, refills steadily and pays one token per request.

    Counted in units of which a token has sixty million, so that a microsecond
    adds ``per_minute`` units and nothing is rounded.
    """
    state = [burst * TOKEN, None]

    def decider(us: int, _: object = None) -> bool:
        level, before = state
        if before is not None:
            level = min(burst * TOKEN, level + (us - before) * per_minute)
        taken = level >= TOKEN
        state[0], state[1] = (level - TOKEN if taken else level), us
        return taken

    return decider


def rate_limit_sliding(
    requests: DataFrame, limit_column: str = "rate_limit", window_seconds: int = 60, windows: int = 64
) -> DataFrame:
    """Replay a request log through a sliding-log limit per client and endpoint.

    Each request is held against its own limit.  ``windows`` is the spacing of cuts in windows.
    """
    keys, width = ["client", "path"], window_seconds * 1_000_000
    cut = calm_segments(requests, keys, "ts", limit_column, window_seconds, windows=windows)
    return decide_in_order(cut, requests.columns, keys, "ts", "request_id", lambda: sliding_log(width), parameter=limit_column)


def rate_limit_bucket(requests: DataFrame, per_minute: int, burst: int, rows: int | None = None) -> DataFrame:
    """Replay a request log through a token bucket per client; ``rows`` bounds the chunks in which cuts are sought."""
    cut = full_segments(requests, ["client"], "ts", "request_id", per_minute, rows)
    return decide_in_order(cut, requests.columns, ["client"], "ts", "request_id", lambda: token_bucket(per_minute, burst))


def _chunk_exits():
    """Tabulate chunks: for each first kept time, the last kept time of the chunk.

    The time carried in lies before the chunk, so the first kept row is one of
    those less than the spacing after the chunk's first row, or the next one.  The
    chains that start at these rows are followed together; chains that keep the
    same row are one from then on.  Neighbouring entries with equal exits are
    written as one.
    """

    def finish(key, chunk, spacing, entries, group_of, parent, last):
        def root(g):
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        out = []
        for entry, group in zip(entries, group_of):
            end = last[root(group)]
            if out and out[-1][3] == end:
                out[-1] = (key, chunk, entry, end, spacing)
            else:
                out.append((key, chunk, entry, end, spacing))
        return out

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "chunk", "entry", "exit", "spacing"]
        current, entries, group_of, parent, last, waiting = None, [], [], [], [], deque()
        for batch in batches:
            done = []
            for key, chunk, us, spacing in zip(batch["__key"], batch["__chunk"], batch["__us"], batch["__spacing"]):
                if (key, chunk) != current:
                    if current is not None:
                        done += finish(*current, held, entries, group_of, parent, last)
                    current, entries, group_of, parent, last, waiting = (key, chunk), [], [], [], [], deque()
                    held = spacing
                    limit, open_ = us + spacing, True
                joined = None
                while waiting and waiting[0][0] <= us:
                    group = waiting.popleft()[1]
                    if joined is None:
                        joined = group
                    else:
                        parent[group] = joined
                if open_ and not (entries and entries[-1] == us):
                    if joined is None:
                        joined = len(parent)
                        parent.append(joined)
                        last.append(us)
                    entries.append(us)
                    group_of.append(joined)
                    open_ = us < limit
                if joined is not None:
                    last[joined] = us
                    waiting.append((us + spacing, joined))
            yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame(finish(*current, held, entries, group_of, parent, last), columns=columns)

    return tabulate


def _carry_states():
    """Read the tables of a key in order: the last kept time each chunk inherits."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, chunk_now, state, settled = None, None, NEVER, False
        for batch in batches:
            out = []
            for key, chunk, entry, end, spacing in zip(*(batch[c] for c in ("key", "chunk", "entry", "exit", "spacing"))):
                if key != current:
                    current, chunk_now, state = key, None, NEVER
                if chunk != chunk_now:
                    chunk_now, settled = chunk, False
                    out.append((key, chunk, state))
                if not settled and entry >= state + spacing:
                    state, settled = end, True
            yield pd.DataFrame(out, columns=["__key", "__chunk", "__state"])

    return fold


def keep_spaced(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, seconds: int | Column, name: str = "kept",
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Keep a row unless a kept row of its key lies less than ``seconds`` before it.

    ``seconds`` may be a column that is the same for all rows of a key.  Chunks are sixteen times the
    spacing, at least an hour, so the tables hold about a sixteenth of the rows or less.
    """
    if isinstance(seconds, Column):
        whole = seconds.cast("long") * F.lit(1_000_000).cast("long")
    else:
        whole = F.lit(int(seconds * 1_000_000)).cast("long")
    width = F.lit(chunk_seconds * 1_000_000) if chunk_seconds else F.greatest(F.lit(3_600_000_000).cast("long"), 16 * whole)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({
        "__us": us, "__chunk": F.floor(us / width).cast("long"), "__key": F.to_json(F.struct(*keys)), "__spacing": whole,
    })
    exits = (
        rows.select("__key", "__chunk", "__us", "__spacing").repartition("__key", "__chunk")
        .sortWithinPartitions("__key", "__chunk", "__us")
        .mapInPandas(_chunk_exits(), "key string, chunk long, entry long, exit long, spacing long")
    )
    states = (
        exits.repartition("key").sortWithinPartitions("key", "chunk", "entry")
        .mapInPandas(_carry_states(), "__key string, __chunk long, __state long")
    )
    laid = (
        rows.withColumn("__state", F.lit(None).cast("long")).unionByName(states, allowMissingColumns=True)
        .repartition("__key", "__chunk")
        .sortWithinPartitions("__key", "__chunk", F.col("__state").isNull(), "__us", tie)
    )
    out_columns = df.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = NEVER
        for batch in batches:
            marks = []
            for state, at, spacing in zip(*(batch.column(c).to_pylist() for c in ("__state", "__us", "__spacing"))):
                if state is not None:
                    last = state
                    marks.append(False)
                else:
                    keep = at >= last + spacing
                    last = at if keep else last
                    marks.append(keep)
            marked = _with_marks(batch, out_columns, name, marks)
            yield marked.filter(batch.column("__state").is_null())

    return laid.mapInArrow(decide, _schema_with(df, name))


def alert_suppress(
    alerts: DataFrame, rules: Sequence[tuple[str, int, str | None]], ts: str = "created_at"
) -> DataFrame:
    """Hide repeats of alerts matched by suppression rules.

    ``rules`` is configuration: (pattern, seconds, condition).  The first rule
    whose pattern is found in the metric name and whose condition (a severity, or
    None) holds applies.  Within its time after the last kept alert of the same
    system and metric further ones are hidden.  All rules are handled at once: the rule
    is part of the key, and brings its time.
    """
    which = None
    for i, (pattern, _, condition) in enumerate(rules):
        hit = F.col("metric_name").rlike(pattern)
        if condition is not None:
            hit = hit & (F.col("severity") == condition)
        which = F.when(hit, i) if which is None else which.when(hit, i)
    if which is None:
        return alerts.withColumn("kept", F.lit(True))
    tagged = alerts.withColumn("__rule", which)
    free = tagged.where(F.col("__rule").isNull()).withColumn("kept", F.lit(True))
    hold = F.element_at(F.array(*[F.lit(int(seconds)).cast("long") for _, seconds, _ in rules]), F.col("__rule") + 1)
    ruled = tagged.where(F.col("__rule").isNotNull())
    return free.unionByName(keep_spaced(ruled, ["system_id", "metric_name", "__rule"], ts, "id", hold)).drop("__rule")
