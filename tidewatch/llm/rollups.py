"""Token counts kept up to date by signed changes, committed in batches that may arrive twice.

A store is a folder with ``data/attempt=*`` (the aggregated deltas) and ``commits/batch=*`` (one
row naming the attempt that counts).  A batch is visible once its commit row is written; a batch
that is delivered again writes a new attempt and points its commit row there, so it counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "tokenizer"]
IMAGE = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"


def signed(changes: DataFrame) -> DataFrame:
    """One negative row for what a change takes away and one positive row for what it adds.

    ``changes`` has ``change_id`` and the images ``before`` and ``after`` (structs of source, lang,
    tokenizer and n_tokens).  An insert has no ``before``, a delete no ``after``, a revised count
    both.  Rows with the same change_id are one change (the smallest images win); rows without
    a change_id are each their own.
    """
    rows = changes.select("change_id", F.col("before").cast(IMAGE).alias("before"), F.col("after").cast(IMAGE).alias("after"))
    once = (
        rows.filter(F.col("change_id").isNotNull())
        .groupBy("change_id").agg(F.min(F.struct("before", "after")).alias("c")).select("c.before", "c.after")
    )
    images = once.unionByName(rows.filter(F.col("change_id").isNull()).select("before", "after")).select(
        F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("image")),
            F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("image")),
        )).alias("s")
    )
    return images.filter(F.col("s.image").isNotNull()).select("s.sign", "s.image.*")


def deltas(changes: DataFrame) -> DataFrame:
    """Additive totals of a batch by source, language and tokenizer version; null counts add no tokens."""
    return signed(changes).groupBy(*KEYS).agg(
        F.sum("sign").alias("n_docs"),
        F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("long").alias("n_tokens"),
    )


def commit(store: str, batch: str, changes: DataFrame) -> None:
    """Add one batch; the same batch again replaces itself, whatever happened to the first try."""
    attempt = uuid.uuid4().hex
    deltas(changes).write.parquet(f"{store}/data/attempt={attempt}")
    row = changes.sparkSession.createDataFrame([(attempt,)], "attempt string")
    row.write.mode("overwrite").parquet(f"{store}/commits/batch={batch}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` over the committed batches.

    Null keys form groups of their own; groups in which no document is left are not listed.
    """
    commits = spark.read.schema("attempt string, batch string").parquet(f"{store}/commits")
    schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, attempt string"
    rows = spark.read.schema(schema).parquet(f"{store}/data").join(commits, "attempt", "left_semi")
    return (
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .filter(F.col("n_docs") != 0)
    )
