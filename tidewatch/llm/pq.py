"""Embedding near-duplicates by product quantisation over inverted lists.

Vectors are normalised and grouped by value.  A coarse quantiser (fitted on a bounded sample) puts
each distinct vector in one inverted list; its residual is coded by the nearest entry of a codebook
per subspace.  A query probes the lists nearest to it, compares its distance table with the codes
of each list, and the survivors are compared exactly.

How many lists are probed is calibrated: on pairs of the sample at the threshold or closer, and on
partners planted there, the number is taken at which the share of pairs found from either end
reaches ``recall``, with a margin.  Of these lists, one that cannot hold a partner is left out: a
partner at most ``delta`` away lies in the cell of centroid ``c`` only if its difference from the query
reaches over the plane between ``c`` and the query's own centroid.  ``exact=True`` probes every list this
bound leaves.  A pair that both ends probe counts where the query comes from the smaller list.  The
table's estimate is off by at most the stored length of the vector's coding error, which is added
before the comparison, so that step loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.components import components
from tidewatch.llm.simhash import spanning
from tidewatch.llm.storage import staged

#: Rows of a list that meet a task at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Quantiser:
    """``centres`` [lists, dim] and ``codebook`` [subspaces, entries, dim / subspaces]."""

    centres: np.ndarray
    codebook: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all centres, and the nearest one."""
        far = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)[None, :]
        return far, far.argmin(1)

    def code(self, residuals: np.ndarray) -> np.ndarray:
        parts = residuals.reshape(len(residuals), len(self.codebook), -1)
        out = np.empty(parts.shape[:2], np.uint8)
        for m, book in enumerate(self.codebook):
            out[:, m] = ((book**2).sum(1)[None, :] - 2 * parts[:, m] @ book.T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebook)], axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = 8, entries: int = 64, seed: int = 3) -> Quantiser:
    """Lloyd's rounds for the coarse centres, then per subspace for the residuals."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    subspaces = max(m for m in range(1, subspaces + 1) if dim % m == 0)
    centres = _means(sample, lists, rng)
    near = ((centres**2).sum(1)[None, :] - 2 * sample @ centres.T).argmin(1)
    parts = (sample - centres[near]).reshape(len(sample), subspaces, -1)
    books = [_means(parts[:, m], entries, rng) for m in range(subspaces)]
    return Quantiser(centres, np.stack(books))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, unit``: vectors of length one (arrays of doubles).

    ``unit`` is null for vectors that are null, empty, zero or hold null or non-finite numbers.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.array_max(F.transform(e, lambda v: F.abs(v)))
    # what a row divides by is spread over an array, as a lambda works it out again for every component
    scaled = F.when(finite & (F.size(e) > 0) & (top > 0), F.zip_with(e, F.array_repeat(top, F.size(e)), lambda v, t: v / t))
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, v: a + v * v))
    return rows.select("vec_id", scaled.alias("scaled")).select(
        "vec_id", F.zip_with("scaled", F.array_repeat(length, F.size("scaled")), lambda v, n: v / n).alias("unit")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def calibrated_probes(q: Quantiser, sample: np.ndarray, threshold: float, recall: float, seed: int = 5) -> int:
    """Lists to probe so that at least ``recall`` of the pairs at ``threshold`` are found from either end.

    The pairs are those of up to 4,000 vectors of the sample, and as many planted partners of each of two
    kinds: turned towards another vector of the sample, and in a random direction.
    """
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:4000]]
    left, right = [], []
    if len(x) > 1:
        first, second = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        some = rng.permutation(len(first))[:20_000]
        left.append(x[first[some]])
        right.append(x[second[some]])
    for towards in (x[rng.permutation(len(x))], rng.standard_normal(x.shape)):
        side = towards - (towards * x).sum(1)[:, None] * x
        length = np.linalg.norm(side, axis=1)
        ok = length > 1e-9
        cosine = threshold + (1 - threshold) / 2 * rng.random(ok.sum())[:, None]
        left.append(x[ok])
        right.append(cosine * x[ok] + np.sqrt(1 - cosine**2) * side[ok] / length[ok][:, None])
    needed = []
    for at in range(0, sum(map(len, left)), 1000):
        a, b = (np.concatenate(side)[at:at + 1000] for side in (left, right))
        (far_a, own_a), (far_b, own_b) = q.assign(a), q.assign(b)
        rows = np.arange(len(a))
        needed.append(np.minimum(
            (far_a < far_a[rows, own_b][:, None]).sum(1), (far_b < far_b[rows, own_a][:, None]).sum(1)
        ))
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(1, np.int64)
    enough = 1 + int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))])
    return min(len(q.centres), math.ceil(1.25 * enough) + 1)


def distinct_links(
    distinct: DataFrame, threshold: float = 0.9, sample_rows: int = 20_000, per_list: int = 256, most_lists: int = 4096,
    recall: float = 0.9999, exact: bool = False,
) -> DataFrame:
    """``kind, a, b, n``: rows ``links`` (``n`` others linked to ``a``, weighted by ``weight``) and ``edge`` (``a`` and ``b`` joined).

    ``distinct`` has ``id, unit, weight`` and one dimension.  The edges connect what is linked
    but need not list every link; the counts do count every one that is found.  The quantiser and the
    number of probes come from at most ``sample_rows`` vectors; lists hold ``per_list`` vectors on average,
    more once there are ``most_lists`` of them.
    """
    n = distinct.count()
    lists = max(1, min(most_lists, sample_rows // 4, math.ceil(n / per_list)))
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    picked = distinct if n <= sample_rows else distinct.filter(near < F.lit(1.2 * sample_rows / n * (1 << 20)))
    sample = _matrix(picked.select("unit").limit(sample_rows).toPandas()["unit"])
    quantiser = fit(sample, lists)
    probes = lists if exact else calibrated_probes(quantiser, sample, threshold, recall)
    shared = distinct.sparkSession.sparkContext.broadcast((quantiser.centres, quantiser.codebook))
    delta = math.sqrt(2 - 2 * threshold) + 1e-6

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = Quantiser(*shared.value)
        norms = (q.centres**2).sum(1)
        for frame in frames:
            for at in range(0, len(frame), 256):
                rows = frame.iloc[at:at + 256]
                x = _matrix(rows["unit"])
                far, own = q.assign(x)
                each = np.arange(len(x))
                residual = x - q.centres[own]
                codes = q.code(residual)
                gap = far - far[each, own][:, None]
                between = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * q.centres[own] @ q.centres.T, 1e-30))
                probed = gap <= 2 * delta * between + 1e-9
                if probes < far.shape[1]:
                    probed &= far <= np.partition(far, probes - 1, axis=1)[:, probes - 1][:, None]
                probed[each, own] = True
                yield pd.DataFrame({
                    "id": rows["id"].to_numpy(), "weight": rows["weight"].to_numpy(), "unit": rows["unit"].to_numpy(), "list": own,
                    "probed": [np.flatnonzero(p).astype(np.int32) for p in probed], "code": [c.tobytes() for c in codes],
                    "error": np.linalg.norm(residual - q.decode(codes), axis=1),
                })

    fields = "id long, weight long, unit array<double>, list int, probed array<int>, code binary, error double"
    placed = staged(distinct.select("id", "weight", "unit").mapInPandas(place, fields), "placed")
    # a list is cut into blocks of members; every query of the list meets every block
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = placed.join(sizes, "list").select(
        "list", own.alias("block"), "id", "weight", "unit", "code", "error", "probed", F.lit(True).alias("member"), F.col("list").alias("home"),
    )
    asking = placed.select(F.explode("probed").alias("list"), "id", "weight", "unit", F.col("list").alias("home")).join(sizes, "list")
    queries = asking.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "weight", "unit",
        F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), F.lit(None).cast("array<int>").alias("probed"),
        F.lit(False).alias("member"), "home",
    )
    dealt = members.unionByName(queries).repartition("list", "block").sortWithinPartitions("list", "block", F.desc("member"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = Quantiser(*shared.value)
        where, held = None, []
        block: dict = {}

        def ready() -> None:
            rows = pd.concat(held)
            unit = _matrix(rows["unit"])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]])
            block.update(
                id=rows["id"].to_numpy(), probed=rows["probed"].tolist(), weight=rows["weight"].to_numpy(), unit=unit, codes=codes, error=rows["error"].to_numpy(),
            )
            held.clear()

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            ids, units = rows["id"].to_numpy(), _matrix(rows["unit"])
            books = q.codebook
            parts = units.reshape(len(units), len(books), -1)
            estimate = (units @ q.centres[where[0]])[:, None] + block["error"][None, :]
            for m, book in enumerate(books):
                estimate += (parts[:, m] @ book.T)[:, block["codes"][:, m]]
            r, c = np.nonzero(estimate >= threshold - 1e-9)
            out = []
            hit_r, hit_c = [], []
            for at in range(0, len(r), 100_000):
                i, j = r[at:at + 100_000], c[at:at + 100_000]
                exact = np.einsum("ij,ij->i", units[i], block["unit"][j])
                ok = (exact >= threshold) & (ids[i] != block["id"][j])
                hit_r.append(i[ok])
                hit_c.append(j[ok])
            r = np.concatenate(hit_r) if hit_r else np.zeros(0, int)
            c = np.concatenate(hit_c) if hit_c else np.zeros(0, int)
            if not len(r):
                return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})
            # a pair of two lists counts for both ends: once, where the query comes from the smaller list if both probe
            home, here = rows["home"].to_numpy()[r], where[0]
            foreign = home != here
            again = np.array([f and h > here and h in block["probed"][j] for f, h, j in zip(foreign, home, c)], bool)
            r, c, foreign = r[~again], c[~again], foreign[~again]
            if not len(r):
                return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})
            counts = np.bincount(r, block["weight"][c], len(ids)).astype(np.int64)
            some = counts > 0
            out.append(pd.DataFrame({"kind": "links", "a": ids[some], "b": ids[some], "n": counts[some]}))
            back = np.bincount(c[foreign], rows["weight"].to_numpy()[r[foreign]], len(block["id"])).astype(np.int64)
            met = back > 0
            out.append(pd.DataFrame({"kind": "links", "a": block["id"][met], "b": block["id"][met], "n": back[met]}))
            a, b = spanning(ids[r], block["id"][c])
            out.append(pd.DataFrame({"kind": "edge", "a": a, "b": b, "n": 0}))
            return pd.concat(out)

        for frame in frames:
            lists, numbers = frame["list"].to_numpy(), frame["block"].to_numpy()
            change = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (numbers[1:] != numbers[:-1])])
            for a, b in zip(change, np.r_[change[1:], len(frame)]):
                rows = frame.iloc[a:b]
                key = (int(lists[a]), int(numbers[a]))
                if key != where:
                    where, block = key, {}
                    held.clear()
                inside = rows["member"].to_numpy()
                if inside.any():
                    held.append(rows[inside])
                asked = rows[~inside]
                if not len(asked):
                    continue
                if held:
                    ready()
                if block:
                    for at in range(0, len(asked), 512):
                        found = compare(asked.iloc[at:at + 512])
                        if len(found):
                            yield found

    return dealt.mapInPandas(search, "kind string, a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row with a vec_id.

    Two vectors are linked at a cosine (in double precision) of ``threshold`` or more.  Vectors
    that are null, empty, zero or hold null or non-finite numbers, and vectors of another length,
    link with nothing (lengths are compared among themselves).  Rows that repeat a vec_id are
    other vectors with the same name.  Rows without a vec_id are left out.  Other columns are ignored.
    ``options`` are those of ``distinct_links``.
    """
    spark = rows.sparkSession
    units = staged(unit_vectors(rows.filter(F.col("vec_id").isNotNull())), "units")
    # equal vectors meet by 128 bits of hash; the classes are numbered once and written
    key = F.struct(F.xxhash64("unit").alias("x"), F.xxhash64(F.lit(7), "unit").alias("y"))
    keyed = units.filter(F.col("unit").isNotNull()).select("vec_id", "unit", key.alias("key"))
    classes = staged(
        keyed.groupBy("key").agg(F.min("vec_id").cast("long").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
        .withColumn("id", F.monotonically_increasing_id()), "classes",
    )
    found = None
    for (size,) in sorted(tuple(r) for r in classes.select(F.size("unit")).distinct().collect()):
        part = staged(distinct_links(classes.filter(F.size("unit") == size), threshold, **options), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "kind string, a long, b long, n long")
    links = found.filter("kind = 'links'").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    reached = components(found.filter("kind = 'edge'").select("a", "b"))
    with_root = classes.select("id", "key", "first", "weight").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "key", "first", "weight", F.coalesce("component", "id").alias("root")
    )
    least = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = with_root.join(least, "root").join(links, "id", "left").select(
        "key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    joined = keyed.select("vec_id", "key").join(by_class, "key").select("vec_id", "n_links", "component_id")
    alone = units.filter(F.col("unit").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")
    )
    return joined.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
