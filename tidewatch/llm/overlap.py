"""Near copies by the Jaccard similarity of shingle sets: pieces of a long SimHash, then exact confirmation.

Two texts of similarity 0.8 differ in 15 % of the bits of a SimHash, in 9.7 of 64 on average; within that many
bits a trie has nearly every pair of nodes.  So the SimHash is made longer and cut into pieces: each piece is
a trie of its own, of which only subtrees under one prefix are walked, within ``BUDGET`` bits.  There are as many
pieces as leave a pair at the threshold in none with probability ``MISS``.  Pairs of rows so found are held
against each other by ``CHECK_BITS`` further bits, and every group that results is decided by its shingle sets.
Subtrees are large, so that prefixes stay short: a longer prefix parts more near copies, which takes more pieces,
and with them more rows and longer SimHashes a text.
Nothing lists all pairs of a group: rows that are joined are not compared again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.components import components
from tidewatch.llm.decontaminate import _bounded
from tidewatch.llm.storage import staged
from tidewatch.llm.tries import roots, self_joined, spanning

#: Bytes that stand between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bits of a piece under its prefix, and how many of them may differ.
TRIE_BITS, BUDGET = 16, 2
#: Texts under one prefix on average; a prefix has ``LEAST_PREFIX`` bits or more.
PER_SUBTREE, LEAST_PREFIX = 50_000, 6
CHECK_BITS = 192
#: Probability that a pair at the threshold meets in no piece; also that its further bits differ too often.
MISS = 1e-7
#: Shingles of a block of a group; two blocks meet in a task.
BLOCK = 4_000_000
#: Rows of pieces that are walked at once, and pairs that are compared at once.
ROWS, PAIRS = 20_000, 1 << 18
MIX = 0x9E3779B97F4A7C15
#: A random number for each place in a word and byte there, one for both cases of A-Z; a word's hash is their sum.
OF_BYTE = np.random.default_rng(12).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
OF_BYTE[:, 0x41:0x5B] = OF_BYTE[:, 0x61:0x7B]
#: Bytes of words, and words, that are hashed at once; blocks of shingles whose bits are counted at once.
HASHED_BYTES, HASHED_WORDS, BLOCKS = 1 << 17, 1 << 16, 64


def class_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts`` (binary, no nulls), and the place of each text's first, and of the end.

    Words are runs of anything but ``WHITE``, only A-Z lower-cased.
    """
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
    ends -= ends[0]
    inside = ~WHITE[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = ends[1:] > ends[:-1]  # a word ends where its text does
    first, last = ends[:-1][filled], ends[1:][filled] - 1
    begin[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(begin)
    sizes = np.flatnonzero(end) + 1 - starts
    hashes = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(sizes <= len(OF_BYTE))
    total = np.cumsum(sizes[short])
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(total, total[at] + HASHED_BYTES)))
        some = short[at:to]
        size = sizes[some]
        before = np.cumsum(size) - size
        nth = np.arange(int(size.sum())) - np.repeat(before, size)
        numbers = OF_BYTE.ravel()[(nth << 8) | raw[np.repeat(starts[some], size) + nth]]
        hashes[some] = np.add.reduceat(numbers, before)
        at = to
    for i in np.flatnonzero(sizes > len(OF_BYTE)):
        word = raw[starts[i]:starts[i] + sizes[i]].tobytes().lower()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, ends)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words are one run as a whole."""
    words = words.view(np.uint64)
    size = min(size, len(words))
    h = np.full(max(1, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        h ^= words[k:len(words) - size + 1 + k]
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
    return h


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, sorted; shorter texts are one shingle as a whole."""
    return np.unique(_runs(words, size))


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text; the runs of many texts are hashed at once."""
    words, bounds = word_hashes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HASHED_WORDS, "right")) - 1)
        some = words[bounds[at]:bounds[to]]
        runs = _runs(some, size)
        for a, b in itertools.pairwise((bounds[at:to + 1] - bounds[at]).tolist()):
            if b - a < size:
                yield shingle_set(some[a:b], size)
                continue
            found = np.sort(runs[a:b - size + 1])
            again = found[1:] == found[:-1]
            yield found[np.r_[True, ~again]] if again.any() else found
        at = to


def _at_most(most: int, bits: int, differing: float) -> float:
    return sum(math.comb(bits, k) * differing ** k * (1 - differing) ** (bits - k) for k in range(most + 1))


def layout(texts: int, similarity: float) -> tuple[int, int, int]:
    """Bits of the prefixes, number of pieces, and how many of the further bits may differ.

    Sets of the similarity differ in a bit most often where they are of one size.
    """
    differing = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    prefix = max(LEAST_PREFIX, math.ceil(math.log2(max(1, texts) / PER_SUBTREE)))
    caught = (1 - differing) ** prefix * _at_most(BUDGET, TRIE_BITS, differing)
    pieces = math.ceil(math.log(MISS) / math.log1p(-min(caught, 0.9)))
    limit = next(most for most in range(CHECK_BITS + 1) if 1 - _at_most(most, CHECK_BITS, differing) <= MISS)
    return prefix, pieces, limit


@functools.lru_cache(8)
def _seeds(words: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, words, dtype=np.uint64)


def _sums(rows: np.ndarray) -> np.ndarray:
    """For blocks of 64 rows of 64-bit words, how many rows of a block have each bit: plane ``p`` has the bits of weight ``2 ** p``.

    Rows are added in pairs, all bits at once.
    """
    planes = [rows]
    while half := planes[0].shape[1] // 2:
        carry, sums = None, []
        for plane in planes:
            a, b = plane[:, :half], plane[:, half:]
            one, both = a ^ b, a & b
            if carry is not None:
                both |= one & carry
                one ^= carry
            carry = both
            sums.append(one)
        planes = [*sums, carry]
    return np.concatenate(planes, axis=1)


def long_simhashes(sets: list[np.ndarray], words: int) -> np.ndarray:
    """``64 * words`` bits (as 0 and 1) of each set: what most of its sorted shingles have, at ties what the first one has."""
    seeds = _seeds(words)
    sizes = np.array([len(s) for s in sets])
    begin = np.r_[0, np.cumsum(-(-sizes // 64))]  # the last block of a set is filled with rows of zeros
    padded = np.zeros(begin[-1] * 64, np.uint64)
    real = np.zeros(len(padded), bool)
    for at, s in zip((begin * 64).tolist(), sets):
        padded[at:at + len(s)] = s
        real[at:at + len(s)] = True
    counts = np.zeros((len(sets), 64 * words), np.float64)
    first = np.empty((len(sets), 64 * words), np.uint8)
    for low in range(0, int(begin[-1]), BLOCKS):
        high = min(low + BLOCKS, int(begin[-1]))
        mixed = padded[low * 64:high * 64, None] ^ seeds
        mixed *= np.uint64(MIX)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed[~real[low * 64:high * 64]] = 0
        sums = _sums(mixed.reshape(high - low, 64, words))
        weights = (1 << np.arange(sums.shape[1])).astype(np.float32)
        bits = np.unpackbits(sums.view(np.uint8), axis=2, bitorder="little")
        for i in range(int(np.searchsorted(begin, low, "right")) - 1, int(np.searchsorted(begin, high))):
            a, b = max(int(begin[i]), low) - low, min(int(begin[i + 1]), high) - low
            counts[i] += weights @ bits[a:b].sum(axis=0, dtype=np.uint8).astype(np.float32)
            if begin[i] >= low:
                first[i] = np.unpackbits(mixed[a * 64].view(np.uint8), bitorder="little")
    return (2 * counts + first > sizes[:, None]).astype(np.uint8)


def long_simhash(shingles: np.ndarray, words: int) -> np.ndarray:
    """The bits of one set."""
    return long_simhashes([shingles], words)[0]


def joined(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that span the graph in which ``alike(i, others)`` marks the neighbours of ``i``."""
    a, b = [], []
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = alike(at, left)
            found = left[hit]
            a += [at] * len(found)
            b += found.tolist()
            queue += found.tolist()
            left = left[~hit]
    return a, b


def _products(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the ranges ``al:ah`` and ``bl:bh``, a bounded number at a time."""
    height, width = ah - al, bh - bl
    filled = np.flatnonzero((height > 0) & (width > 0))
    ends = np.cumsum((height * width)[filled])
    at = 0
    while at < len(filled):
        # as many ranges as make few pairs; one range that makes more goes row by row, in slices
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right"))
        some = filled[at:max(at + 1, to)]
        if to > at:
            rows = np.arange(height[some].sum()) + np.repeat(al[some] - np.cumsum(height[some]) + height[some], height[some])
            size = np.repeat(width[some], height[some])
            start = np.repeat(bl[some], height[some]) - np.cumsum(size) + size
            yield np.repeat(rows, size), np.arange(size.sum()) + np.repeat(start, size)
        else:
            one = int(some[0])
            step = max(1, PAIRS // int(width[one]))
            for row in range(int(al[one]), int(ah[one]), step):
                rows = np.arange(row, min(row + step, int(ah[one])))
                for low in range(int(bl[one]), int(bh[one]), PAIRS):
                    others = np.arange(low, min(low + PAIRS, int(bh[one])))
                    yield np.repeat(rows, len(others)), np.tile(others, len(rows))
        at += len(some)


def piece_links(k: np.ndarray, signs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that connect all rows whose pieces are near and whose ``signs`` differ in ``limit`` bits at most.

    ``k`` is sorted: the number of the piece, its prefix, and its bits under the prefix.  Rows of one ``k`` make a leaf.
    """
    columns = [np.ascontiguousarray(column) for column in signs.T]

    def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        differing = np.bitwise_count(columns[0][i] ^ columns[0][j])
        for column in columns[1:]:
            differing += np.bitwise_count(column[i] ^ column[j])
        return differing <= limit

    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    last = np.r_[first[1:], len(k)]
    size = last - first
    x, y = self_joined(k[first], TRIE_BITS, BUDGET)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        hit = near(i, j)
        a.append(i[hit])
        b.append(j[hit])

    # rows of one leaf, then the first rows of two leaves
    few = (size > 1) & (size <= 64)
    for i, j in _products(first[few], last[few], first[few], last[few]):
        add(i[i < j], j[i < j])
    for lo, hi in zip(first[size > 64], last[size > 64]):
        i, j = joined(hi - lo, lambda i, others: near(lo + i, lo + others))
        a.append(lo + np.array(i, np.int64))
        b.append(lo + np.array(j, np.int64))
    for at in range(0, len(x), PAIRS):
        add(first[x[at:at + PAIRS]], first[y[at:at + PAIRS]])
    # then all rows of two leaves that are not joined by now
    label = roots(len(k), np.concatenate(a), np.concatenate(b))
    pairs = size[x] * size[y]
    small = (pairs > 1) & (pairs <= 64)
    for i, j in _products(first[x[small]], last[x[small]], first[y[small]], last[y[small]]):
        apart = np.flatnonzero(label[i] != label[j])
        add(i[apart], j[apart])
    # in large leaves the rows that are joined by now go as one
    x, y = x[pairs > 64], y[pairs > 64]
    leaf = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((label, leaf))
    begin = np.flatnonzero(np.r_[True, (leaf[order][1:] != leaf[order][:-1]) | (label[order][1:] != label[order][:-1])])
    end = np.r_[begin[1:], len(k)]
    unit_low, unit_high = np.searchsorted(begin, first), np.searchsorted(begin, last)
    for i, j in _products(unit_low[x], unit_high[x], unit_low[y], unit_high[y]):
        apart = label[order[begin[i]]] != label[order[begin[j]]]
        i, j = i[apart], j[apart]
        for p, q in _products(begin[i], end[i], begin[j], end[j]):
            add(order[p], order[q])
    return np.concatenate(a), np.concatenate(b)


def candidate_links(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """``a, b``: links that connect all texts (``class_of``) whose SimHashes are near in a piece and in the further bits."""
    prefix, pieces, limit = layout(docs.count(), similarity)
    width = prefix + TRIE_BITS
    words = -(-(CHECK_BITS + pieces * width) // 64)
    checks = [f"check{i}" for i in range(CHECK_BITS // 64)]

    def sketch(batches):
        for batch in batches:
            classes, sets = batch.column("c").to_numpy(), _sets(batch.column("text"), size)
            at = 0
            while some := list(itertools.islice(sets, 64)):
                bits = long_simhashes(some, words)
                signs = np.packbits(bits[:, :CHECK_BITS], axis=1, bitorder="little").view(np.int64)
                cut = bits[:, CHECK_BITS:CHECK_BITS + pieces * width].reshape(len(some), pieces, width)
                k = (cut @ (1 << np.arange(width))) + (np.arange(pieces) << width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(classes[at:at + len(some)]), *map(pa.array, signs.T),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * pieces), pa.array(k.ravel())),
                ], ["c", *checks, "pieces"])
                at += len(some)

    texts = docs.select(class_of(F.col("text")).alias("c"), _bytes(F.col("text")).alias("text"))
    sketches = texts.mapInArrow(sketch, f"c long, {', '.join(f'{x} long' for x in checks)}, pieces array<long>")
    sketches = staged(sketches.groupBy("c").agg(*[F.any_value(x).alias(x) for x in (*checks, "pieces")]), "sketches")
    dealt = sketches.select("c", *checks, F.explode("pieces").alias("k"))
    dealt = dealt.repartition(F.shiftright("k", TRIE_BITS)).sortWithinPartitions("k")

    def walk(frames):
        def links(frame):
            signs = frame[checks].to_numpy().view(np.uint64)
            a, b = piece_links(frame["k"].to_numpy(), signs, limit)
            c = frame["c"].to_numpy()
            a, b = spanning(c[a], c[b])
            return pd.DataFrame({"a": a, "b": b}, dtype="int64")

        parts, rows, goal = [], 0, ROWS
        for frame in frames:  # sorted: subtrees are walked once the last of them is complete
            parts.append(frame)
            rows += len(frame)
            if rows >= goal:
                whole = pd.concat(parts)
                tree = whole["k"].to_numpy() >> TRIE_BITS
                done = int(np.searchsorted(tree, tree[-1]))
                if done:
                    yield links(whole[:done])
                parts = [whole[done:]]
                rows = len(parts[0])
                goal = max(ROWS, 2 * rows)
        if rows:
            yield links(pd.concat(parts))

    return dealt.mapInPandas(walk, "a long, b long")


def similar_links(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """``a, b``: links that connect all texts (``class_of``) whose shingle sets have the Jaccard similarity or more."""
    groups = staged(components(candidate_links(docs, similarity, size)), "groups")

    def to_sets(batches):
        for batch in batches:
            sets = list(_sets(batch.column("text"), size))
            yield pa.RecordBatch.from_arrays([
                batch.column("c"), batch.column("component"), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["c", "component", "n", "hashes"])

    texts = docs.select(class_of(F.col("text")).alias("c"), "text").join(_bounded(groups.withColumnRenamed("node", "c")), "c")
    sets = texts.select("c", "component", _bytes(F.col("text")).alias("text")).mapInArrow(
        to_sets, "c long, component long, n int, hashes binary"
    )
    sets = staged(sets.dropDuplicates(["c"]), "sets")
    # a group is cut into blocks of bounded size, and every two blocks meet
    blocks = sets.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    cut = sets.join(blocks, "component").withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "c", "n", "hashes")

    def confirm(c: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sizes, kind="stable")
        c, sizes = c[order], sizes[order]
        held = [np.frombuffer(h, np.uint64) for h in hashes[order]]

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(others), bool)
            fits = np.flatnonzero(np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9)
            for at in range(0, len(fits), 256):
                some = fits[at:at + 256]
                flat = np.concatenate([held[o] for o in others[some]])
                place = np.minimum(np.searchsorted(held[i], flat), len(held[i]) - 1)
                shared = np.add.reduceat((held[i][place] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes[others[some]])[:-1]])
                hit[some] = shared >= similarity * (sizes[others[some]] + sizes[i] - shared) - 1e-9
            return hit

        a, b = joined(len(c), alike)
        return c[np.array(a, np.int64)], c[np.array(b, np.int64)]

    def groups_of(frames):
        parts, open_group = [], None
        for frame in filter(len, frames):  # sorted: a group is confirmed once its last row is there
            keys = frame[["component", "x", "y"]].to_numpy()
            columns = [frame[name].to_numpy() for name in ("c", "n", "hashes")]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            found = []
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(frame)]):
                if parts and (keys[lo] != open_group).any():
                    found.append(confirm(*map(np.concatenate, zip(*parts))))
                    parts = []
                open_group = keys[lo]
                parts.append([column[lo:hi] for column in columns])
            if found:
                yield links(found)
        if parts:
            yield links([confirm(*map(np.concatenate, zip(*parts)))])

    def links(found):
        a, b = map(np.concatenate, zip(*found))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    group = ["component", "x", "y"]
    return cut.repartition(*group).sortWithinPartitions(*group).mapInPandas(groups_of, "a long, b long")
