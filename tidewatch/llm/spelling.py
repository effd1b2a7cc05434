"""Spelling variants: groups of words one edit apart, by PartEnum signatures.

A word is seen as the binary vector of its letter multiset, one dimension for each letter and
occurrence.  One inserted, deleted or replaced letter changes at most two dimensions, and these
belong to at most two letters.  The letters are partitioned into ``parts`` classes; for every choice
of ``parts - 2`` classes the word's letters of these classes are a signature, so two words at a
distance of two or less agree in the signature that leaves out the classes of the changed letters.
The letters keep their order in it, which is exact as well (no letter of a chosen class moved) and
tells anagrams apart.  Equal signatures meet in one equi-join, and every pair is verified.

All joins are merge joins.  Words grow with the documents and signatures are thirty times as many, yet Spark
takes an exploded table for as large as the one below it, whose files are packed: it would broadcast them.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.storage import staged

#: Runs of letters up to U+00FF in UTF-8, of which A-Z are lower-cased before.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 300_000


def word_counts(docs: DataFrame, least_chars: int = 6, least_n: int = 5, thinned: int | None = None) -> DataFrame:
    """``word, n`` of all words of at least ``least_chars`` code points with ``least_n`` occurrences.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, of whole texts.
    With ``thinned``, a run loses the code point ``h % length`` where ``thinned`` divides
    ``h = crc32("<doc_id>:<run>")``; a row without doc_id keeps its runs as they are.  Null texts have
    no words.  Every row counts, repeated ones too.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode() for w in total], pa.string()), "n": pa.array(list(total.values()), pa.int64()),
            })
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if not text.is_valid:
                    continue
                runs = Counter(RUNS.findall(text.as_py().encode().lower()))
                if thinned and doc_id.is_valid:
                    start = zlib.crc32(b"%d:" % doc_id.as_py())
                    # all are taken out first: what a run becomes may be another thinned run, and is not thinned again
                    for run, n in [(r, runs.pop(r)) for r in list(runs) if zlib.crc32(r, start) % thinned == 0]:
                        word = run.decode()
                        at = zlib.crc32(run, start) % len(word)
                        runs[(word[:at] + word[at + 1:]).encode()] += n
                total.update(runs)
                if len(total) > HELD_WORDS:
                    yield flush()
        if total:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").filter(F.char_length("word") >= least_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def letter_classes(words: DataFrame, parts: int) -> list[str]:
    """The letters in ``parts`` classes of about equal use; at most one row a letter comes to the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    used = letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()
    classes, load = [""] * parts, [0] * parts
    for row in used:
        least = load.index(min(load))
        classes[least] += row["letter"]
        load[least] += row["count"]
    return classes


def _signatures(classes: list[str], length: Column) -> Column:
    """One hash for each pair of classes left out."""
    left_out = [a + b for a, b in itertools.combinations(classes, 2)]
    return F.array(*[
        F.xxhash64(F.lit(i), length, F.translate("word", letters, "") if letters else F.col("word")) for i, letters in enumerate(left_out)
    ])


def near_pairs(words: DataFrame, parts: int = 6) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of words of ``word, n`` one edit apart, once.

    Signatures carry the length of the longer word: a word stands on one side under its own length,
    and on the other under its own and the next.
    """
    classes = letter_classes(words, parts)
    length = F.char_length("word")
    longer = words.select(F.explode(_signatures(classes, length)).alias("signature"), F.col("word").alias("b"), F.col("n").alias("b_n"), length.alias("b_size"))
    both = F.concat(_signatures(classes, length), _signatures(classes, length + 1))
    shorter = words.select(F.explode(both).alias("signature"), F.col("word").alias("a"), F.col("n").alias("a_n"), length.alias("a_size"))
    fits = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    met = shorter.join(longer.hint("merge"), (shorter.signature == longer.signature) & fits & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last of the chain, by joining each chain with itself.

    A round doubles the links a word has followed.  Forms grow in n, so chains have no circles.
    """
    chains = staged(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = staged(chains.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        chains = joined.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, parts: int = 6) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``word, n`` (distinct words, no nulls).

    ``form`` is the near word of the largest n, at equal n the smallest in code-point order, if that n
    is ``ratio`` times the word's or more, else null; ``root`` is the last word reached by following
    forms, the word itself if it has none.  An empty table gives an empty result.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words, parts), "near")
    turned = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    best = pairs.unionByName(turned).groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus_n"), F.col("b").alias("near"))).alias("best")
    )
    chosen = -F.col("best.minus_n") >= ratio * F.col("n")
    known = staged(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"),
        F.when(chosen, -F.col("best.minus_n")).alias("form_n"),
    ), "variants")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
