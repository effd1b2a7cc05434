"""Exact percentiles of all keys: small keys in a buffer each, large ones by refinement.

A key of at most ``BUFFERED_ROWS`` values keeps them in one aggregation buffer.  The values of a larger
key are not sorted: one combining aggregate counts them in coarse relative ranges, whose running
counts (a bounded number a key) tell which ranges hold a wanted rank; only the values in these are
counted one by one and ranked, in chunks.  The same ranges carry the moments of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.operators import ordered
from tidewatch.operators.chunks import VALUE_BITS, measured, prefixed, same, value_position

#: Values of a key up to which they meet in one buffer.
BUFFERED_ROWS = 100_000
#: Large keys, and ranges with a wanted rank, up to which they are broadcast to the rows.
BROADCAST_KEYS = 1_000
BROADCAST_RANGES = 20_000
MOMENTS = ("n", "mean", "std", "min", "max")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], moments: bool = False,
) -> DataFrame:
    """One row a key with its linear-interpolation percentiles, and with ``n, mean, std, min, max`` if asked.

    Nulls and NaN are left out; a key without other values has no row.  The deviation is that of
    the population.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    used = df.where(F.col(value).isNotNull() & ~F.isnan(number)).select(*keys, F.col(value).alias("__v"))
    held = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BUFFERED_ROWS)
    found, large = measured(held, BROADCAST_KEYS)
    if not found:
        return _buffered(used, keys, quantiles, moments)
    if not keys:
        return _refined(used, keys, quantiles, moments)
    there = prefixed(large, keys, "__k_")
    few = used.join(there, same(keys, "__k_"), "left_anti")
    many = used.join(there, same(keys, "__k_"), "left_semi")
    return _buffered(few, keys, quantiles, moments).unionByName(_refined(many, keys, quantiles, moments))


def _buffered(used: DataFrame, keys: list[str], quantiles: dict[str, float], moments: bool) -> DataFrame:
    """Percentiles of the values ``__v`` of small keys."""
    v = F.col("__v").cast("double")
    aggs = [F.percentile("__v", [float(q) for q in quantiles.values()]).alias("__q"), F.count(F.lit(1)).alias("n")]
    if moments:
        aggs += [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min("__v").alias("min"), F.max("__v").alias("max")]
    columns = [F.col("__q")[i].alias(name) for i, name in enumerate(quantiles)]
    return used.groupBy(*keys).agg(*aggs).where("n > 0").select(*keys, *columns, *(MOMENTS if moments else ()))


def _refined(used: DataFrame, keys: list[str], quantiles: dict[str, float], moments: bool) -> DataFrame:
    """Percentiles of the values ``__v`` of large keys."""
    by = [*keys, "__cell"]
    used = used.withColumn("__p", value_position(F.col("__v"))).withColumn("__cell", F.shiftright("__p", VALUE_BITS))
    parts = [F.count(F.lit(1)).alias("__n")]
    if moments:
        v = F.col("__v").cast("double")
        parts += [F.sum(v).alias("__s"), F.var_pop(v).alias("__d"), F.min("__v").alias("__min"), F.max("__v").alias("__max")]
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ranges = used.groupBy(*by).agg(*parts).withColumns({
        "__before": F.coalesce(F.sum("__n").over(upto), F.lit(0)), "__all": F.sum("__n").over(whole),
    })
    carried = ["__before", "__all"]
    if moments:
        ranges = ranges.withColumn("mean", F.sum("__s").over(whole) / F.col("__all"))
        off = F.col("__s") / F.col("__n") - F.col("mean")
        spread = F.col("__n") * (F.col("__d") + off * off)
        ranges = ranges.withColumns({
            "std": F.sqrt(F.sum(spread).over(whole) / F.col("__all")), "min": F.min("__min").over(whole),
            "max": F.max("__max").over(whole), "n": F.col("__all"),
        })
        carried += MOMENTS
    ranks = {name: F.lit(float(q)) * (F.col("__all") - 1) for name, q in quantiles.items()}
    holds = F.lit(False)
    for rank in ranks.values():
        for r in (F.floor(rank), F.ceil(rank)):
            holds = holds | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    _, wanted = measured(ranges.where(holds).select(*by, *carried), BROADCAST_RANGES)
    there = wanted.select(*[F.col(c).alias(f"__d_{c}") for c in by], *[F.col(c).alias(f"__c_{c}") for c in carried])
    counts = used.join(there, same(by, "__d_")).groupBy(*by, "__v", "__p").agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(f"__c_{c}").alias(c) for c in carried]
    )
    ranked = ordered.running(
        counts, by, ["__v"], F.shiftright("__p", VALUE_BITS - 12), __cum=ordered.running_sum(F.col("__n"))
    ).withColumn("__upto", F.col("__before") + F.col("__cum"))
    aggs = []
    for name, rank in ranks.items():
        aggs.append(F.min(F.when(F.col("__upto") > F.floor(rank), F.col("__v"))).alias(f"__lo_{name}"))
        aggs.append(F.min(F.when(F.col("__upto") > F.ceil(rank), F.col("__v"))).alias(f"__hi_{name}"))
    out = ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried if c != "__before"], *aggs)
    columns = []
    for name, rank in ranks.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        # equal neighbours need no interpolation, which infinities do not have
        columns.append(F.when(lo == hi, lo.cast("double")).otherwise(lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return out.select(*keys, *columns, *(MOMENTS if moments else ()))
