"""Ranked lexical search: Block-Max MaxScore over segments of a compressed inverted index.

``build_index`` cuts the documents into segments of a bounded number of terms.  A segment holds one
row a block of at most ``BLOCK`` postings: gaps and term frequencies as variable-length bytes, and
the block's impact front, the pairs (frequency, document length) that no other posting of the block
beats in both.  A front needs no corpus statistics, so the index is written in one pass over the
texts, and gives the exact largest score of a block once they are known.

``search`` joins the index to the query terms, and each segment ranks its documents by itself: lists
are taken by falling upper bound while the bounds of the rest could still lift a new document into
the best ``k`` (the essential lists); of the others, block maxima reject candidates before a block
is decompressed.  The best of all segments meet in a ranked window, cut to ``k`` before the shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.storage import shared_folder, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms in UTF-8 once A-Z are lower-cased; the same for Spark's expressions on queries.
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
QUERY_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 128
#: Terms with repeats in a segment, unless one text has more.
SEGMENT_TERMS = 2_000_000
#: Pairs of a query and a term that a segment answers at a time.
QUERY_PAIRS = 200_000
INDEX = (
    "segment string, term string, block int, first_doc int, last_doc int, postings long, terms long, "
    "front_tf array<int>, front_n array<int>, data binary"
)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers below 2^35 as bytes, seven bits each and low bits first, and the bytes of each."""
    sizes = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        part = (values[has] >> (7 * k)) & 0x7F
        out[ends[has] - sizes[has] + k] = part | np.where(sizes[has] > k + 1, 0x80, 0)
    return out, sizes


def unpack(data: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 0x80
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, np.int64)


def fronts(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indexes, by block, of the postings with fewer terms in their document than all of as many or more occurrences."""
    order = np.lexsort((n, -tf, block))
    shifted = n[order] - block[order] * (int(n.max()) + 1)  # every block starts below all before it
    least = np.minimum.accumulate(shifted)
    return order[np.concatenate([[True], shifted[1:] < least[:-1]])]


class Numbering(dict):
    """Terms in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _segment(name: str, doc_ids: list[int], codes: list[np.ndarray], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: its documents in the row without a term, then the blocks by term."""
    n = np.array([len(c) for c in codes], np.int64)
    terms = sorted(known)
    rank = np.empty(len(terms), np.int64)
    rank[[known[t] for t in terms]] = np.arange(len(terms))
    docs = len(n)
    pairs, tf = np.unique(rank[np.concatenate(codes)] * docs + np.repeat(np.arange(docs), n), return_counts=True)
    term, doc = np.divmod(pairs, docs)
    new_term = np.concatenate([[True], term[1:] != term[:-1]])
    within = np.arange(len(term)) - np.flatnonzero(new_term)[np.cumsum(new_term) - 1]
    starts = np.flatnonzero(within % BLOCK == 0)
    block = np.cumsum(within % BLOCK == 0) - 1
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = 0
    data, sizes = pack(np.stack([gaps, tf], 1).reshape(-1))
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, starts * 2))]).astype(np.int32)
    front = fronts(block, tf, n[doc])
    front_bounds = np.concatenate([[0], np.cumsum(np.bincount(block[front], minlength=len(starts)))]).astype(np.int32)
    counts = np.diff(np.append(starts, len(term)))

    def ints(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(front_bounds), pa.array(values.astype(np.int32)))

    schema = pa.schema([
        ("segment", pa.string()), ("term", pa.string()), ("block", pa.int32()), ("first_doc", pa.int32()), ("last_doc", pa.int32()),
        ("postings", pa.int64()), ("terms", pa.int64()), ("front_tf", pa.list_(pa.int32())), ("front_n", pa.list_(pa.int32())), ("data", pa.binary()),
    ])
    own = np.concatenate([np.array(doc_ids, np.int64), n]).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
        (name, None, None, None, None, docs, int(n.sum()), None, None, own), schema)], schema=schema)
    names = pa.array([t.decode() for t in terms], pa.string()).take(pa.array(term[starts]))
    whole = pa.RecordBatch.from_arrays([
        pa.array([name] * len(starts), pa.string()), names, pa.array((within[starts] // BLOCK).astype(np.int32)),
        pa.array(doc[starts].astype(np.int32)), pa.array(doc[starts + counts - 1].astype(np.int32)), pa.array(counts),
        pa.nulls(len(starts), pa.int64()), ints(tf[front]), ints(n[doc][front]),
        pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]),
    ], schema=schema)
    for at in range(0, len(starts), 10_000):
        yield whole.slice(at, 10_000)


def build_index(docs: DataFrame, path: str, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """Index whole texts of ``doc_id, text`` under ``path`` and return the index.

    Terms are the maximal runs of digits, A-Z, a-z and characters from U+0080 on, only A-Z lower-cased.
    Rows without doc_id, and texts without a term, are not in it; each repeated row is a document.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, size, known = [], [], 0, Numbering()
        names = (f"{TaskContext.get().partitionId()}-{k}" for k in itertools.count())
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                terms = TERMS.findall(text.as_py().encode().lower())
                if not terms:
                    continue
                ids.append(doc_id.as_py())
                codes.append(np.fromiter(map(known.__getitem__, terms), np.int32, len(terms)))
                size += len(terms)
                if size >= segment_terms:
                    yield from _segment(next(names), ids, codes, known)
                    ids, codes, size, known = [], [], 0, Numbering()
        if ids:
            yield from _segment(next(names), ids, codes, known)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(rows, INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Segment:
    """The lists of a segment that some query asks for."""

    def __init__(self, frame: pd.DataFrame, all_docs: int, all_terms: int):
        own = frame[frame["term"].isna()].iloc[0]
        ids = np.frombuffer(own["data"], np.int64)
        self.doc_ids, n = ids[:len(ids) // 2], ids[len(ids) // 2:]

        def slowed(n: np.ndarray) -> np.ndarray:
            return 25 + (75 * n * all_docs) // all_terms

        self.m = slowed(n)
        frame = frame[frame["term"].notna()].sort_values(["term", "block"])
        self.first, self.last = frame["first_doc"].to_numpy(np.int64), frame["last_doc"].to_numpy(np.int64)
        self.data = frame["data"].tolist()
        starts = frame["block"].to_numpy() == 0
        self.bounds = np.append(np.flatnonzero(starts), len(frame))
        heads = frame[starts]
        self.weights = heads["weight"].to_numpy(np.int64)
        self.queries: dict[int, list[tuple[int, int]]] = {}
        for k, (items, repeats) in enumerate(zip(heads["items"], heads["repeats"])):
            for item, times in zip(items, repeats):
                self.queries.setdefault(int(item), []).append((k, int(times)))
        sizes = frame["front_tf"].str.len().to_numpy(np.int64)
        if len(sizes):
            tf, n = (np.concatenate(frame[c].tolist()).astype(np.int64) for c in ("front_tf", "front_n"))
            self.most = np.maximum.reduceat(impact(tf, slowed(n)), np.cumsum(sizes) - sizes)

    def postings(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and what one occurrence of a term in the query adds, of blocks of one list."""
        docs, tf = [], []
        for b in blocks:
            values = unpack(self.data[b])
            docs.append(self.first[b] + np.cumsum(values[0::2]))
            tf.append(values[1::2])
        docs, tf = np.concatenate(docs), np.concatenate(tf)
        return docs, impact(tf, self.m[docs])

    def best(self, wanted: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, and of all that tie with the last."""
        factor = np.array([self.weights[t] * times for t, times in wanted])
        spans = [range(self.bounds[t], self.bounds[t + 1]) for t, _ in wanted]
        bound = factor * np.array([self.most[s.start:s.stop].max() for s in spans])
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        scores, least, at = np.zeros(len(self.m), np.int64), 1, 0
        while at < len(order) and rest[at] >= least:  # essential: documents of this list alone may be among the best
            docs, gain = self.postings(spans[order[at]])
            scores[docs] += factor[order[at]] * gain
            at += 1
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        docs = np.flatnonzero(scores + rest[at] >= least)
        docs = docs[scores[docs] > 0]
        scores = scores[docs]
        if at < len(order):
            lists = order[at:]
            limits, blocks = np.zeros((len(lists), len(docs)), np.int64), np.zeros((len(lists), len(docs)), np.int64)
            for row, one in enumerate(lists):
                span = spans[one]
                b = np.maximum(np.searchsorted(self.first[span.start:span.stop], docs, "right") - 1, 0) + span.start
                inside = (docs >= self.first[b]) & (docs <= self.last[b])
                blocks[row], limits[row] = b, np.where(inside, factor[one] * self.most[b], 0)
            upper = scores + limits.sum(0)
            for row, one in enumerate(lists):
                keep = upper >= least
                docs, scores, upper, limits, blocks = docs[keep], scores[keep], upper[keep], limits[:, keep], blocks[:, keep]
                need = np.unique(blocks[row][limits[row] > 0])
                if len(need):
                    listed, gain = self.postings(need)
                    place = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                    gained = np.where(listed[place] == docs, factor[one] * gain[place], 0)
                    scores, upper = scores + gained, upper - limits[row] + gained
                    if len(scores) >= k:
                        least = max(least, int(np.partition(scores, -k)[-k]))
        keep = scores >= least
        return docs[keep], scores[keep]


def query_terms(queries: DataFrame) -> DataFrame:
    """``item_id, term, repeats`` of ``item_id, text``; of several texts of an item the smallest counts."""
    items = queries.filter("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(QUERY_TERMS), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).cast("int").alias("repeats"))


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query, equal scores by doc_id.

    A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document adds
    ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + 75 n N div L`` for each time the query holds it.
    Documents of score 0 are not listed.  Null item_ids and texts ask for nothing; the same row twice
    is one query.
    """
    pairs = staged(query_terms(queries), "query-terms")
    blocks = -(-pairs.count() // QUERY_PAIRS)
    size = index.filter("term IS NULL").agg(F.sum("postings"), F.sum("terms")).first()
    if not blocks or not size[0]:
        return pairs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    all_docs, all_terms = int(size[0]), int(size[1])
    asked = pairs.select("item_id", "term", "repeats", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("query_block")).groupBy("query_block", "term").agg(
        F.collect_list(F.struct("item_id", "repeats")).alias("asked")
    )
    lists = index.filter("term IS NOT NULL")
    held = lists.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("postings").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(all_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighted = staged(asked.join(held, "term").select(
        "query_block", "term", F.col("asked.item_id").alias("items"), F.col("asked.repeats").alias("repeats"), weight.alias("weight")
    ), "weights")
    head = F.col("block") == 0
    met = lists.drop("terms").join(weighted, "term").withColumns({"items": F.when(head, F.col("items")), "repeats": F.when(head, F.col("repeats"))})
    own = index.filter("term IS NULL").drop("terms").withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        segment = Segment(frame, all_docs, all_terms)
        found = [(item, *segment.best(wanted, k)) for item, wanted in segment.queries.items()]
        lengths = [len(docs) for _, docs, _ in found]
        return pd.DataFrame({
            "item_id": np.repeat(np.array([item for item, _, _ in found], np.int64), lengths),
            "doc_id": segment.doc_ids[np.concatenate([d for _, d, _ in found])] if found else np.zeros(0, np.int64),
            "score": np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64),
        })

    best = met.unionByName(own, allowMissingColumns=True).groupBy("query_block", "segment").applyInPandas(rank, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``search`` in an index of ``docs`` made in the shared folder."""
    return search(build_index(docs, shared_folder(docs.sparkSession, "index")), queries, k)
