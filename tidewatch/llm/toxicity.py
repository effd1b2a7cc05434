"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into buckets), so misspelt and
compound forms share most of their vectors with the forms seen in training.  A text is the mean
of its words.  As all of that is linear, scoring needs one number a word: the model is projected
once, and tasks look up their distinct words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.storage import staged

WORD = re.compile(r"[^\W_]+")
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
#: Words whose score a task remembers.
REMEMBERED = 400_000
#: Words whose n-grams are held at once.
PROJECTED = 10_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of the n-grams of ``<word>`` (UTF-8 bytes, 3 to 5), and the first of each word."""
    blob = np.frombuffer("".join(f"<{w}>" for w in words).encode(), np.uint8).astype(np.uint64)
    sizes = np.array([len(w.encode()) + 2 for w in words])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(blob))  # bytes up to the end of the word
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 0x9E3779B97F4A7C15 + n, np.uint64)
        for k in range(n):
            h = (h ^ blob[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        found.append((h % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    found.append(np.array([zlib.crc32(w.encode()) % BUCKETS for w in words], np.int32))
    owners.append(np.arange(len(words)))
    grams, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Model:
    """``bucket``: each bucket's share in the log odds of label 1; ``bias``: what is added to a text's mean.

    ``empty``: the log odds of a text without words, those of label 1 in training.
    """

    bucket: np.ndarray
    bias: float
    empty: float

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, first = word_grams(words)
        return np.add.reduceat(self.bucket[grams].astype(np.float64), first) / np.diff(np.r_[first, len(grams)])


def train(
    texts: list[str], labels: list[int], dim: int = 2, rounds: int = 60, rate: float = 0.05, scale: float = 300.0,
    min_share: float = 0.01, positive: float = 0.2, decay: float = 4e-4, seed: int = 5,
) -> Model:
    """Embeddings and softmax together, by Adam over all ``texts`` at once.

    ``scale`` multiplies the mean before the softmax, since a few words of a text decide.
    ``positive`` is the weight of all texts of label 1 together.  A bucket gets a vector if at least two texts and
    ``min_share`` times as many as the rarer label has are found with it.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = []
    for text in texts:
        words = words_of(text)
        coded.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
    keep = [i for i, c in enumerate(coded) if len(c)]
    y = np.array([labels[i] for i in keep], np.int64)
    if not len(keep) or y.min() == y.max():
        share = min(max(float(np.mean(labels)), 1e-3), 1 - 1e-3) if labels else 0.01
        prior = float(np.log(share / (1 - share)))
        return Model(np.zeros(BUCKETS, np.float32), prior, prior)
    code = np.concatenate([coded[i] for i in keep])
    lengths = np.array([len(coded[i]) for i in keep])
    # a bucket that few texts have would only learn these texts by heart: it stays zero
    texts_with = np.zeros(len(vocabulary))
    for c in coded:
        texts_with[np.unique(c)] += 1
    all_words = list(vocabulary)
    del coded, vocabulary
    sizes = np.zeros(len(all_words), np.int64)
    in_texts = np.zeros(BUCKETS)
    blocks = range(0, len(all_words), 20_000)
    for at in blocks:
        some, begin = word_grams(all_words[at:at + 20_000])
        size = np.diff(np.r_[begin, len(some)])
        sizes[at:at + len(size)] = size
        in_texts += np.bincount(some, np.repeat(texts_with[at:at + len(size)], size), BUCKETS)
    # the n-grams are made again, so that only those of common buckets are held
    common = in_texts >= max(2.0, min_share * np.bincount(y).min())
    used = np.flatnonzero(common)
    place = np.cumsum(common, dtype=np.int32) - 1
    local, owner = [], []
    for at in blocks:
        some, _ = word_grams(all_words[at:at + 20_000])
        of = np.repeat(np.arange(at, min(at + 20_000, len(all_words)), dtype=np.int32), sizes[at:at + 20_000])
        local.append(place[some[common[some]]])
        owner.append(of[common[some]])
    local, owner = np.concatenate(local), np.concatenate(owner)
    del all_words
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    text_of = np.repeat(np.arange(len(keep), dtype=np.int32), lengths)
    if not len(used):
        used, local, owner = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)
    e = rng.uniform(-0.02, 0.02, (len(used), dim))
    w, b = rng.choice([-0.5, 0.5], (dim, 1)) * np.array([-1.0, 1.0]), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    target = np.eye(2)[y]
    weight = np.where(y == 1, positive / (y == 1).sum(), (1 - positive) / (y == 0).sum())[:, None]
    for step in range(1, rounds + 1):
        words = np.stack([np.bincount(owner, e[:, k][local], len(sizes)) for k in range(dim)], 1) / sizes[:, None]
        mean = np.stack([np.add.reduceat(words[:, k][code], starts) for k in range(dim)], 1) / lengths[:, None]
        logits = scale * mean @ w + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) * weight
        d_mean = scale * d @ w.T / lengths[:, None]
        d_words = np.stack([np.bincount(code, d_mean[:, k][text_of], len(sizes)) for k in range(dim)], 1) / sizes[:, None]
        d_e = np.stack([np.bincount(local, d_words[:, k][owner], len(used)) for k in range(dim)], 1) + decay * e
        grads = (d_e, scale * mean.T @ d, d.sum(0))
        for (m, v), value, grad, pace in zip(state, (e, w, b), grads, (rate, 0.03, 0.3)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= pace * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[used] = scale * e @ (w[:, 1] - w[:, 0])
    return Model(bucket, float(b[1] - b[0]), float(np.log(positive / (1 - positive))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = 2000, longest: int = 50_000, **options) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``learn`` holds.

    ``labels`` has doc_id and label; a doc_id with both labels teaches nothing.  The sample has
    up to ``per_label`` documents of each label, those with the smallest hash of doc_id, among
    labelled documents of at most ``longest`` characters; it is all that comes to the driver.
    """
    agreed = (
        labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    )
    # written once: else every count and every draw below would go through all ids again
    known = staged(agreed.join(docs.select("doc_id").filter(learn & F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi"), "labelled")
    short = docs.filter(F.length("text") <= longest).select("doc_id", "text")
    near = F.xxhash64("doc_id")
    rows = []
    for value in (0, 1):
        of = known.filter(F.col("label") == value)
        most = of.count()
        share_of = F.lit(1.0) if most <= per_label else F.lit(1.25 * per_label / most)
        drawn = F.pmod(near, F.lit(1 << 20)) < share_of * (1 << 20)
        # some 1.25 x per_label ids, never over twice as many: small enough for every task
        ids = F.broadcast(of.filter(drawn).orderBy(near).limit(2 * per_label))
        rows += short.filter(learn & drawn).join(ids, "doc_id").orderBy(near, "text").limit(per_label).select("text", "label").collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows], **options)


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the probability of label 1; a text without words gets the share in training.

    A column of that name in ``docs`` is replaced, other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.bias, model.empty))

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        projected = Model(*shared.value)
        known: dict[str, float] = {}
        for texts in columns:
            out = np.empty(len(texts))
            for at in range(0, len(texts), 64):
                found = [words_of(t) for t in texts.iloc[at:at + 64]]
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in {w for words in found for w in words} if w not in known]
                for start in range(0, len(new), PROJECTED):
                    part = new[start:start + PROJECTED]
                    known.update(zip(part, projected.words(part).tolist()))
                for k, words in enumerate(found):
                    odds = sum(map(known.__getitem__, words)) / len(words) + projected.bias if words else projected.empty
                    out[at + k] = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pd.Series(out)

    return docs.withColumn(into, score(F.col("text").cast("string")))
