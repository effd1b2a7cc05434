"""Benchmark decontamination: MinHash containment search in size partitions, then exact containment.

Test items are short and documents long, so their Jaccard similarity says nothing; what counts
is how much of the *item* lies in the document.  The item's MinHash sketch (its smallest shingle
hashes) is therefore looked up in the documents.  Items are partitioned by size: a partition
of items with at most ``u`` shingles keeps ``floor((1 - threshold) * u) + 1`` hashes, one more than
an item of that size may lack, so no item at or above the threshold is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.storage import staged

WORD = r"[\p{L}\p{N}]+"
#: Rows up to which a lookup table is broadcast (at most about 100 bytes a row); beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _starts(size: int) -> Column:
    """The start of each shingle of ``words``; an empty array for fewer words."""
    last = F.size("words") - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hash_at(i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get("words", i + k) for k in range(size)])


def _shingles(size: int) -> Column:
    """Hash and text of each shingle of ``words``.

    Explode it alone (no row then carries the words) and as outer: for an inner explode Spark would
    push a test for empty arrays below the projection and split the text again for every shingle.
    """
    return F.transform(_starts(size), lambda i: F.struct(
        _hash_at(i, size).alias("h"), F.array_join(F.slice("words", i + 1, size), " ").alias("shingle")
    ))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, size: int = 5) -> DataFrame:
    """``key, item_id, h, shingle, q``: the distinct shingles of each different (item_id, text)."""
    keyed = (
        items.select("item_id", "text").filter(F.col("item_id").isNotNull()).distinct()
        .select(F.xxhash64("item_id", "text").alias("key"), "item_id", words_of(F.col("text")).alias("words"))
    )
    rows = keyed.select("key", "item_id", F.explode_outer(_shingles(size)).alias("s")).select(
        "key", "item_id", "s.h", "s.shingle"
    ).filter(F.col("h").isNotNull()).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("q"))
    return rows.join(sizes, "key")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """``key, h, need, least``: the MinHash sketch of each item.

    ``need`` hashes of the sketch lie in every document at the threshold, and such a document has
    at least ``least`` shingles.
    """
    spare = 1 - threshold
    bound = F.pow(F.lit(2.0), F.ceil(F.log2("q")))
    k = (F.floor(bound * spare + 1e-9) + 1).cast("int")
    per_item = shingles.groupBy("key", "q").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    sketch = per_item.select(
        "key", F.slice("hs", F.lit(1), F.least(k, F.size("hs"))).alias("sketch"),
        (F.least(k, F.size("hs")) - F.floor(F.col("q") * spare + 1e-9)).alias("need"),
        F.ceil(F.col("q") * threshold - 1e-9).alias("least"),
    )
    return sketch.select("key", F.explode("sketch").alias("h"), "need", "least")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` of pairs at or above ``threshold``.

    ``containment`` is the share of the item's distinct ``size``-word shingles found in the
    document.  Words are runs of letters and digits in lower case.  Null and short texts have no
    shingles: such items are never reported and such documents never found.  Rows without an id
    are left out.  Rows that share a doc_id are one document; repeated items count once, and of
    different texts under one item_id the best is reported.  Other columns are ignored.
    """
    shingles = staged(item_shingles(items, size), "items")
    sketch = _bounded(sketches(shingles, threshold))
    worded = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashed = worded.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", F.size("words").alias("n"), F.transform(_starts(size), lambda i: _hash_at(i, size)).alias("hs")
    )
    hits = (
        hashed.select("doc_id", "n", F.explode_outer("hs").alias("h")).join(sketch, "h")
        .groupBy("doc_id", "key", "h", "need", "least").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        .groupBy("doc_id", "key", "need", "least").agg(F.count(F.lit(1)).alias("hits"))
    )
    pairs = staged(hits.filter(F.col("hits") >= F.col("need")).select("doc_id", "key"), "candidates")

    found = (
        worded.join(_bounded(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
        .select("doc_id", words_of(F.col("text")).alias("words"))
        .select("doc_id", F.explode_outer(_shingles(size)).alias("s"))
        .select("doc_id", "s.h", "s.shingle")
        .join(_bounded(shingles), ["h", "shingle"])
        .groupBy("doc_id", "key", "item_id", "q", "shingle").agg(F.count(F.lit(1)).alias("times"))
        .join(pairs, ["doc_id", "key"], "left_semi")
        .groupBy("doc_id", "key", "item_id", "q").agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= F.col("q") * threshold - 1e-9)
    )
    best = F.max(F.struct((F.col("shared") / F.col("q")).alias("containment"), "shared", "q"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.shared", F.col("best.q").alias("item_shingles"), "best.containment"
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The documents in which no item is found; documents without an id stay."""
    leaked = contaminated(docs, items, threshold, size).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)
