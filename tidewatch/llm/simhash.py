"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are grouped first, so copies cost nothing.  The distinct ones form a binary trie.
Its nodes at depth ``p`` are the tasks' unit: two subtrees can hold a link only if their prefixes
differ in at most ``budget`` bits, so every fingerprint is sent to the pairs of prefixes it can
take part in (1 + p + p(p-1)/2 of them for a budget of 2), and both tries of a pair are walked
together from there on.  Links leave a task as a spanning forest, and components are found in Spark.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.components import components
from tidewatch.llm.decontaminate import _bounded
from tidewatch.llm.overlap import class_of, similar_links
from tidewatch.llm.storage import free_name, staged
from tidewatch.llm.tries import spanning, trie_links

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"
#: Fingerprints a subtree holds on average.
PER_SUBTREE = 256


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, WHITE), lambda w: w != "").alias("words")


def _hashes(size: int) -> Column:
    """XXH64 (seed 42) of the shingles of ``words``, repeats included."""
    n = F.size("words")
    starts = F.when(n >= size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).when(n > 0, F.array(F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("words", i, size), " ")))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, 4096 hashes at a time."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.ascontiguousarray(hashes[at:at + 4096]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp``: the 64-bit fingerprint as a signed long; no words give zero.

    A-Z are lower-cased, words are runs of anything but blank, tab, line feed, vertical tab, form
    feed and carriage return, and texts of fewer than ``size`` words hash as a whole.
    """
    def majority(batches):
        for batch in batches:
            lists = batch.column("hashes")
            values = lists.values.to_numpy(zero_copy_only=False) if len(lists.values) else np.zeros(0, np.int64)
            ends = lists.offsets.to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            fps = [
                _majority(values[a:b]) if ok and b > a else 0
                for a, b, ok in zip(ends[:-1], ends[1:], valid)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    hashed = docs.select("doc_id", _words(F.col("text"))).select("doc_id", _hashes(size).alias("hashes"))
    kind = dict(docs.dtypes)["doc_id"]
    return hashed.mapInArrow(majority, f"doc_id {kind}, fp long")


def fingerprint_links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """``a, b``: links (longs) that connect all fingerprints ``fp`` within ``budget`` bits of each other."""
    n = distinct.count()
    depth = max(0, min(24, math.ceil(math.log2(max(1, n) / PER_SUBTREE)))) if n else 0
    masks = [
        sum(1 << k for k in chosen) for r in range(min(budget, depth) + 1) for chosen in itertools.combinations(range(depth), r)
    ]
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    sent = distinct.select("fp", prefix.alias("p"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    other = F.col("p").bitwiseXOR(F.col("m"))
    low, high = F.least("p", other), F.greatest("p", other)
    sent = sent.select((low * F.lit(1 << depth) + high).alias("pair"), (F.col("p") > other).cast("long").alias("side"), "fp")

    def walk(frames):
        def links(parts):
            frame = pd.concat(parts)
            fps = frame["fp"].to_numpy().view(np.uint64)
            a, b = trie_links(frame["pair"].to_numpy(), frame["side"].to_numpy(), fps, depth, budget)
            a, b = spanning(fps[a].view(np.int64), fps[b].view(np.int64))
            return pd.DataFrame({"a": a, "b": b})

        parts, rows = [], 0
        for frame in frames:  # sorted by pair: a batch is walked once its last pair is complete
            parts.append(frame)
            rows += len(frame)
            if rows >= 200_000:
                whole = pd.concat(parts)
                open_pair = whole["pair"].iloc[-1]
                done = whole[whole["pair"] != open_pair]
                if len(done):
                    yield links([done])
                parts = [whole[whole["pair"] == open_pair]]
                rows = len(parts[0])
        if rows:
            yield links(parts)

    dealt = sent.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, size: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row with a doc_id.

    Documents whose fingerprints differ in at most ``budget`` bits are linked; ``component_id`` is
    the smallest doc_id that links reach.  Null and empty texts have fingerprint zero and are linked
    like any other.  Rows without doc_id are left out, repeated rows appear as often as given.
    Other columns are ignored.
    """
    fps = staged(fingerprints(docs.filter(F.col("doc_id").isNotNull()), size), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    reached = components(fingerprint_links(classes.select("fp"), budget))
    joined = classes.join(reached, classes["fp"] == reached["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; repeated rows stay once.

    Texts whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more are
    linked; SimHash pieces and the trie join find them (``overlap``).  Rows are told apart by doc_id and text: of different texts under one doc_id each has its
    own group.  Rows without doc_id come after all others, so one stays only where its group has no other.
    Other columns stay as they are, whatever their names.
    """
    row, text_class = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), class_of(F.col("text"))
    rows = staged(docs.select("doc_id", row.alias("r"), text_class.alias("c")), "rows")
    reached = staged(components(similar_links(docs, similarity, size)), "reached")
    grouped = rows.join(reached, rows["c"] == reached["node"], "left").select(
        "r", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "r").alias("order"), F.coalesce("component", "c").alias("root")
    )
    best = grouped.groupBy("root").agg(F.min("order").alias("best"))
    copies = staged(grouped.join(best, "root").filter(F.col("r") != F.col("best.r")).select("r").distinct(), "copies")
    mark = free_name(docs, "r")
    kept = docs.withColumn(mark, row).join(_bounded(copies.withColumnRenamed("r", mark)), mark, "left_anti")
    if not rows.groupBy("r").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([mark])
    return kept.select(docs.columns)
