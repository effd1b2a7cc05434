"""Chunks of a key that hold a bounded number of rows.

A fixed piece of time is one task however many rows it holds.  Here an axis (a time, a value) is cut
into cells of fixed width, a combining aggregate counts the rows of each key and cell, and only cells
above the bound are cut further: first along 4,096 fine cells, then, where a fine cell alone is above
half the bound, along single positions.  Keys and cells within the bound cost one count and nothing
else.  The table of cuts has one row a dense cell; rows look their piece up in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows of a chunk unless an operator is told otherwise; read when a plan is made.
ROWS_PER_CHUNK = 1_000_000
#: Dense cells up to which the table of cuts (at most 4,096 cuts a row, as a rule) is broadcast.
BROADCAST_CELLS = 1_000
FINE = 4096
HOUR_US = 3_600_000_000
#: Bits of a value position below its coarse cell; a cell spans 1/64 of a natural logarithm.
VALUE_BITS = 26
PIECES = 1 << 32


@dataclass(frozen=True)
class RowChunks:
    """Cut along ``position`` (a long that does not decrease along the order) into at most ``rows`` rows.

    Rows of one position stay together, however many they are.  ``rows`` is ``ROWS_PER_CHUNK`` if None.
    """

    position: Column
    width: int
    rows: int | None = None

    @property
    def most(self) -> int:
        return self.rows or ROWS_PER_CHUNK


def row_chunks(ts: str, rows: int | None = None) -> RowChunks:
    """Hours of a timestamp column, dense ones cut."""
    return RowChunks(F.unix_micros(F.col(ts).cast("timestamp")), HOUR_US, rows)


def value_position(value: Column) -> Column:
    """A long that does not decrease with the value: fine near zero, 2.3e-10 of the value far from it."""
    size = F.floor(F.log1p(F.abs(value.cast("double")) * 1e6) * float(1 << 32))
    return F.when(value < 0, -size).otherwise(size)


def value_chunks(value: str, rows: int | None = None) -> RowChunks:
    """Relative ranges of a number, dense ones cut."""
    return RowChunks(value_position(F.col(value)), 1 << VALUE_BITS, rows)


def measured(df: DataFrame, most: int) -> tuple[list, DataFrame]:
    """The rows of ``df`` if they are ``most`` at most, as a table to broadcast; else the plan itself.

    The list holds ``most + 1`` rows at most.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return rows, df
    return rows, F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def same(left: Sequence[str], right: str) -> list[Column]:
    """Null-safe equality of columns with those of the same name and a prefix."""
    return [F.col(c).eqNullSafe(F.col(f"{right}{c}")) for c in left]


def prefixed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _starts(counts: DataFrame, by: Sequence[str], along: str, n: str, most: int, first: Column) -> DataFrame:
    """Where pieces of about ``most`` rows begin, from counts along an axis."""
    before = F.sum(n).over(Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    piece = F.floor(F.coalesce(before, F.lit(0)) / F.lit(most))
    return counts.withColumn("__piece", piece).groupBy(*by, "__piece").agg(F.min(first).alias("__start")).drop("__piece")


def _piece(starts: Column, position: Column) -> Column:
    """How many of the sorted ``starts`` are at or below ``position``."""
    steps = F.array(*[F.lit(1 << b) for b in range(20, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.try_element_at(starts, at + step) <= position, step).otherwise(0)
    )


def with_chunks(df: DataFrame, keys: Sequence[str], cut: RowChunks, name: str) -> DataFrame:
    """Add the chunk ``name`` (a long, monotone in the position) of each row within its key."""
    keys = list(keys)
    if name not in df.columns:
        df = df.withColumn(name, F.lit(None).cast("long"))
    kept = [c for c in df.columns if c != name]
    at = df.drop(name).withColumn("__p", cut.position).withColumn("__cell", F.floor(F.col("__p") / F.lit(cut.width)))
    plain = F.col("__cell") * PIECES
    held = at.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    found, dense = measured(held.where((F.col("__n") > cut.most) & F.col("__cell").isNotNull()), BROADCAST_CELLS)
    if not found:
        return at.select(*kept, plain.alias(name))

    by, half = [*keys, "__cell"], max(1, cut.most // 2)
    fine = max(1, cut.width // FINE)
    inside = at.select(*by, "__p").join(prefixed(dense, by, "__d_"), same(by, "__d_"), "left_semi")
    counts = inside.groupBy(*by, F.floor(F.col("__p") / F.lit(fine)).alias("__fine")).agg(F.count(F.lit(1)).alias("__n"))
    starts = _starts(counts, by, "__fine", "__n", half, F.col("__fine") * fine)
    finest = [*by, "__fine"]
    some, crowded = measured(counts.where(F.col("__n") > half).select(*finest), BROADCAST_CELLS)
    if some and fine > 1:
        close = inside.withColumn("__fine", F.floor(F.col("__p") / F.lit(fine))).join(
            prefixed(crowded, finest, "__d_"), same(finest, "__d_"), "left_semi"
        )
        single = close.groupBy(*finest, "__p").agg(F.count(F.lit(1)).alias("__n"))
        starts = starts.unionByName(_starts(single, finest, "__p", "__n", half, F.col("__p")).drop("__fine"))
    table = starts.groupBy(*by).agg(F.array_sort(F.collect_set("__start")).alias("__starts"))
    table = table.select(*[F.col(c).alias(f"__d_{c}") for c in by], "__starts")
    if len(found) <= BROADCAST_CELLS:
        table = F.broadcast(table)
    joined = at.join(table, same(by, "__d_"), "left")
    return joined.select(*kept, (plain + F.coalesce(_piece(F.col("__starts"), F.col("__p")), F.lit(0))).alias(name))
