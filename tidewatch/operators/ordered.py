"""Ordered per-key computations that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task.  When one series holds a third of all rows, that task is the job.  The
functions here cut each key into chunks along the order (an hour of a series,
say), work inside chunks in parallel, and carry a small summary from chunk to
chunk:

1. ``groupBy(key, chunk)`` makes one summary row per chunk.  It is an aggregate,
   so it combines before the shuffle.
2. A window over the *summaries* gives each chunk what came before it.  Its size
   is the number of chunks (time span / chunk width), not the number of rows.
3. The carry enters the chunk as one extra row in front of its rows.  One window
   over ``(key, chunk)`` then continues from it.  The rows are shuffled and
   sorted once, and nothing is joined.

``order`` is a list of column names, ascending, and must be a total order within
a key.  ``chunk`` must not decrease along the order: a column, or ``RowChunks``,
which measures the rows and bounds those of a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.operators.chunks import RowChunks, row_chunks, value_chunks, with_chunks

__all__ = ["RowChunks", "row_chunks", "value_chunks"]
_CHUNK = "__chunk"
_CARRY = "__carry"


@dataclass(frozen=True)
class Scan:
    """One output of :func:`running`.

    kind: ``previous`` (value of the row before), ``sum``, ``max`` and ``last``
    (last non-null) up to and including the row, ``max_before`` (strictly before
    the row), ``row_number``, ``total_sum`` (over the whole key).
    """

    kind: str
    value: Column | None = None


def previous(value: Column) -> Scan:
    return Scan("previous", value)


def running_sum(value: Column) -> Scan:
    return Scan("sum", value)


def running_max(value: Column) -> Scan:
    return Scan("max", value)


def max_before(value: Column) -> Scan:
    return Scan("max_before", value)


def last_known(value: Column) -> Scan:
    return Scan("last", value)


def row_number() -> Scan:
    return Scan("row_number")


def total_sum(value: Column) -> Scan:
    return Scan("total_sum", value)


def time_chunk(ts: str, width: str = "hour") -> Column:
    """Chunk of a timestamp column: its hour, day, ..."""
    return F.date_trunc(width, F.col(ts))


def number_chunk(column: str, size: int) -> Column:
    """Chunk of an integral column: consecutive ranges of ``size``."""
    return F.floor(F.col(column) / F.lit(size))


def _summary(scan: Scan, order: Column) -> Column:
    if scan.kind == "previous":
        return F.max_by(F.struct(scan.value.alias("v")), order)
    if scan.kind == "last":
        return F.max_by(scan.value, F.when(scan.value.isNotNull(), order))
    if scan.kind in ("max", "max_before"):
        return F.max(scan.value)
    if scan.kind == "row_number":
        return F.count(F.lit(1))
    return F.sum(scan.value)


def _carry(scan: Scan, summary: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if scan.kind == "previous":
        return F.lag(summary).over(window)
    if scan.kind == "last":
        return F.last(summary, ignorenulls=True).over(before)
    if scan.kind in ("max", "max_before"):
        return F.max(summary).over(before)
    if scan.kind == "total_sum":
        return F.sum(summary).over(
            window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    return F.sum(summary).over(before)


def _input(scan: Scan) -> Column:
    """What a row brings to the window; the carry row brings the carry."""
    if scan.kind == "previous":
        return F.struct(scan.value.alias("v"))
    if scan.kind == "row_number":
        return F.lit(1).cast("long")
    if scan.kind == "total_sum":
        return F.lit(None)
    return scan.value


def _output(scan: Scan, value: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if scan.kind == "previous":
        return F.lag(value).over(window)["v"]
    if scan.kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if scan.kind == "max":
        return F.max(value).over(upto)
    if scan.kind == "max_before":
        return F.max(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    if scan.kind == "total_sum":
        return F.first(value, ignorenulls=True).over(upto)
    return F.sum(value).over(upto)


def _with_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | RowChunks, scans: dict[str, Scan]
) -> tuple[DataFrame, object]:
    """Rows with their chunk and scan inputs, carry rows in front, and the window."""
    df = with_chunks(df, keys, chunk, _CHUNK) if isinstance(chunk, RowChunks) else df.withColumn(_CHUNK, chunk)
    order_struct = F.struct(*[F.col(c) for c in order])
    summaries = df.groupBy(*keys, _CHUNK).agg(
        *[_summary(s, order_struct).alias(f"__s_{n}") for n, s in scans.items()]
    )
    over_chunks = Window.partitionBy(*keys).orderBy(_CHUNK)
    carries = summaries.select(
        *keys, _CHUNK, F.lit(True).alias(_CARRY),
        *[_carry(s, F.col(f"__s_{n}"), over_chunks).alias(f"__i_{n}") for n, s in scans.items()],
    )
    rows = df.select(
        "*", F.lit(False).alias(_CARRY), *[_input(s).alias(f"__i_{n}") for n, s in scans.items()]
    )
    window = Window.partitionBy(*keys, _CHUNK).orderBy(F.desc(_CARRY), *order)
    return rows.unionByName(carries, allowMissingColumns=True), window


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | RowChunks,
    **scans: Scan,
) -> DataFrame:
    """Add one column per scan to ``df``."""
    keys = list(keys)
    rows, window = _with_carry(df, keys, order, chunk, scans)
    kept = [c for c in df.columns if c not in scans]
    scanned = rows.select(
        *kept, _CARRY, *[_output(s, F.col(f"__i_{n}"), window).alias(n) for n, s in scans.items()]
    )
    return scanned.where(~F.col(_CARRY)).drop(_CARRY)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | RowChunks,
    prev: dict[str, Column],
    starts: Column,
    name: str = "island",
) -> DataFrame:
    """Number the islands of each key: a new one begins where ``starts`` holds.

    ``prev`` names columns holding values of the preceding row; ``starts`` may
    use them.  Where only aggregates of the islands are wanted,
    :func:`island_aggregates` needs one shuffle of the rows instead of two.
    """
    with_prev = running(df, keys, order, chunk, **{n: previous(c) for n, c in prev.items()})
    flagged = with_prev.withColumn("__start", F.when(starts, 1).otherwise(0).cast("long"))
    out = running(flagged, keys, order, chunk, **{name: running_sum(F.col("__start"))})
    return out.drop("__start")


_MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def island_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | RowChunks,
    prev: dict[str, Column],
    starts: Column,
    **aggregates: tuple[str, Column],
) -> DataFrame:
    """Aggregates of the islands of each key (see :func:`islands`), one row each.

    ``aggregates`` are ``(function, column)`` with the functions min, max, sum and
    count (of non-null values).  Inside a chunk islands get local numbers and are
    aggregated where they lie.  Only the piece at the front of a chunk can belong
    to an island begun earlier; it learns which one from the chunk summaries.
    Rows before the first start of a key belong to no island.
    """
    keys = list(keys)
    scans = {n: previous(c) for n, c in prev.items()}
    rows, window = _with_carry(df, keys, order, chunk, scans)
    seen = rows.select(
        *df.columns, _CHUNK, _CARRY,
        *[_output(s, F.col(f"__i_{n}"), window).alias(n) for n, s in scans.items()],
    )
    begins = F.when(F.col(_CARRY), 0).when(starts, 1).otherwise(0)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = seen.withColumn("__start", begins).withColumn(
        "__local", F.sum("__start").over(upto)
    ).where(~F.col(_CARRY))
    pieces = numbered.groupBy(*keys, _CHUNK, "__local").agg(
        *[(F.count(c) if f == "count" else _MERGE[f](c)).alias(n) for n, (f, c) in aggregates.items()]
    )
    # Only the first and the last piece of a chunk can touch another chunk.  They
    # meet per key (two per chunk); the pieces between are spread by a hash and
    # only pass through the window.
    chunk_pieces = Window.partitionBy(*keys, _CHUNK)
    edge = (F.col("__local") == 0) | (F.col("__local") == F.max("__local").over(chunk_pieces))
    spread = F.pmod(F.xxhash64(_CHUNK, "__local"), F.lit(4096)) + 1
    met = pieces.withColumn("__salt", F.when(edge, F.lit(0)).otherwise(spread))
    begun = F.when(F.col("__local") > 0, F.struct(F.col(_CHUNK).alias("c"), F.col("__local").alias("n")))
    so_far = Window.partitionBy(*keys, "__salt").orderBy(_CHUNK, "__local").rowsBetween(Window.unboundedPreceding, 0)
    resolved = met.withColumn("__from", F.last(begun, ignorenulls=True).over(so_far))
    return resolved.where(F.col("__from").isNotNull()).groupBy(*keys, "__from").agg(
        *[_MERGE[f](n).alias(n) for n, (f, _) in aggregates.items()]
    ).drop("__from")


def blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | RowChunks,
    halo: int,
    size: int = 100_000,
) -> DataFrame:
    """Cut each key into blocks of ``size`` rows for ``rowsBetween`` windows.

    Adds ``row_no`` (1-based in the key), ``block`` and ``is_halo``.  Each block
    is preceded by copies (``is_halo``) of the last ``halo`` rows before it, so a
    window over ``(key, block)`` that looks back at most ``halo`` rows is exact.
    Blocks have equal size whatever the distribution of the key.
    """
    if size < max(halo, 1):
        raise ValueError("a block must be at least as long as its halo")
    numbered = running(df, keys, order, chunk, row_no=row_number())
    offset = F.pmod(F.col("row_no") - 1, F.lit(size))
    own = F.floor((F.col("row_no") - 1) / F.lit(size)).cast("long")
    copy = F.when(offset >= size - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        numbered.withColumn("__shift", F.explode(copy))
        .withColumn("block", own + F.col("__shift"))
        .withColumn("is_halo", F.col("__shift") == 1)
        .drop("__shift")
    )


def trailing_sums(
    df: DataFrame, keys: Sequence[str], ts: str, span_seconds: int, include_now: bool,
    rows: int | None = None, **sums: Column,
) -> DataFrame:
    """Sums over the rows of a key in ``[ts - span, ts]``, or ``[ts - span, ts)``.

    A sliding range frame adds up its rows again for every row.  Here each row enters a running sum
    at its time and leaves it (negated) when the span is over, so the work is linear.  The time axis
    is cut into slices as long as the span, so that errors of rounding do not add up over a whole key:
    a row enters in its own slice and leaves in the next, which begins with the total of the slice
    before it, one row.  A slice is cut into chunks of ``rows`` rows, each of which begins with what the
    chunks before it add up to, so no task holds a whole span.  Rows of one time stay together.
    """
    keys, names = list(keys), list(sums)
    span = span_seconds * 1_000_000
    slice_of = F.floor(F.col("__us") / F.lit(span)).cast("long")
    inputs = df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()]).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    inputs = inputs.withColumn("__slice", slice_of)
    # a leaving row counts from the instant after the last that still sees it
    shift = F.when(F.col("__own"), 0).otherwise(1)
    moves = inputs.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        *df.columns, "__own", (F.col("__slice") + shift).alias("__slice"),
        (F.col("__us") + shift * F.lit(span + int(include_now))).alias("__at"),
        *[(F.col(f"__v_{n}") * (1 - 2 * shift)).alias(f"__v_{n}") for n in names],
    )
    begun = inputs.groupBy(*keys, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in names]).select(
        *keys, F.lit(False).alias("__own"), (F.col("__slice") + 1).alias("__slice"),
        ((F.col("__slice") + 1) * span - 1).alias("__at"), *[f"__v_{n}" for n in names],
    )
    events = moves.unionByName(begun, allowMissingColumns=True)
    cut = with_chunks(events, [*keys, "__slice"], RowChunks(F.col("__at"), min(span, 3_600_000_000), rows), _CHUNK)
    held = cut.groupBy(*keys, "__slice", _CHUNK).agg(*[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in names])
    before = Window.partitionBy(*keys, "__slice").orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = held.select(
        *keys, "__slice", _CHUNK, F.lit(False).alias("__own"), F.lit(-(1 << 62)).alias("__at"),
        *[F.sum(f"__v_{n}").over(before).alias(f"__v_{n}") for n in names],
    )
    upto = Window.partitionBy(*keys, "__slice", _CHUNK).orderBy("__at").rangeBetween(
        Window.unboundedPreceding, 0 if include_now else -1
    )
    # dealt by chunk even where the rows come dealt by key, as from a join, which would do for the window
    dealt = cut.unionByName(carries, allowMissingColumns=True).repartition(*keys, "__slice", _CHUNK)
    out = dealt.select(
        *df.columns, "__own", *[F.sum(f"__v_{n}").over(upto).alias(n) for n in names]
    )
    return out.where("__own").drop("__own")
