"""K-means fits: seeded samples, initialisers and the mini-batch step, as sums over partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Distance, distances_to, is_whole, lists, nearest, sq_distances, sum_rows, whole_matrix


@dataclass
class Codebook:
    """Centroids (K, d) and how many points each has taken so far."""

    centroids: np.ndarray
    counts: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.counts is None:
            self.counts = np.zeros(len(self.centroids))


#: First centroids: ``init(df, key, col, k, seed, distances)`` of the vectors of a table.
Initializer = Callable[[DataFrame, str, str, int, int, Distance], Codebook]


def init_buffer(df: DataFrame, key: str, col: str, size: int = 3072, n_clusters: int = 1, seed: int = 0) -> np.ndarray:
    """``size`` vectors (all, if fewer) in seeded order: a bounded sample. Null vectors are passed over; fewer than ``n_clusters`` are an error."""
    order = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.filter(is_whole(col)).select(key, F.col(col).cast("array<double>").alias("v")).orderBy(order, key).limit(size).collect()
    if len(rows) < n_clusters:
        raise ValueError(f"{len(rows)} points for {n_clusters} clusters")
    return np.array([r["v"] for r in rows])


def init_random(df: DataFrame, key: str, col: str, k: int, seed: int = 0, distances: Distance = sq_distances) -> Codebook:
    return Codebook(init_buffer(df, key, col, k, k, seed))


def fraction(seed: int, draw: int) -> float:
    """A number from 0 below 1 by the digest of the seed and the draw's number."""
    return int(hashlib.md5(f"{seed}-{draw}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def pick(weights: np.ndarray, u: float) -> int:
    """The first place at which the weights so far exceed the share ``u`` of all."""
    upto = np.cumsum(weights)
    return int(min(np.searchsorted(upto, u * upto[-1], side="right"), np.flatnonzero(weights)[-1]))


def init_kmeanspp(buffer: np.ndarray, k: int, seed: int = 0, weights: np.ndarray | None = None, distances: Distance = sq_distances) -> Codebook:
    """k-means++ on a buffer: the first point by weight (evenly, if none are given), each next by its distance to the nearest chosen times its weight; once all are zero, evenly among the rest. Draw j takes the point at which the summed weights exceed the ``fraction`` j of all, so that SQL can repeat it."""
    if len(buffer) < k:
        raise ValueError(f"{len(buffer)} points for {k} clusters")
    weights = np.ones(len(buffer)) if weights is None else weights
    chosen = [pick(weights, fraction(seed, 0))]
    d = distances_to(buffer, buffer[chosen[0]], distances)
    while len(chosen) < k:
        p = d * weights
        if not p.any():
            p = np.ones(len(buffer))
            p[chosen] = 0
        chosen.append(pick(p, fraction(seed, len(chosen))))
        d = np.minimum(d, distances_to(buffer, buffer[chosen[-1]], distances))
    return Codebook(buffer[chosen].copy())


def from_buffer(size: int = 3072) -> Initializer:
    """k-means++ on a bounded sample."""

    def init(df, key, col, k, seed=0, distances=sq_distances):
        return init_kmeanspp(init_buffer(df, key, col, size, k, seed), k, seed, distances=distances)

    return init


def from_fit(max_iter: int = 100, atol: float = 1e-8, init: Initializer | None = None) -> Initializer:
    """The centroids that a whole k-means fit ends with."""

    def run(df, key, col, k, seed=0, distances=sq_distances):
        return Codebook(fit_kmeans(df, key, col, k, max_iter, atol, seed=seed, init=init, distances=distances)[0].centroids)

    return run


def init_kmeans_parallel(df: DataFrame, key: str, col: str, k: int, seed: int = 0, distances: Distance = sq_distances, rounds: int = 5, oversample: float = 2.0) -> Codebook:
    """k-means++ for a table of any size (k-means||): in each round a row is chosen with a chance of ``oversample * k`` by its share of the distances; the few chosen, weighted by the rows nearest to them, are clustered on the driver.

    The chance comes from a digest of key, round and seed. About ``rounds *
    oversample * k`` rows reach the driver, whatever the table's size.
    """
    rows = df.filter(is_whole(col)).select(F.col(key).alias("_k"), F.col(col).cast("array<double>").alias("_v"))
    chosen = init_buffer(df, key, col, 1, 1, seed)
    for step in range(rounds):
        def far(batches, chosen=chosen):
            for b in batches:
                d = np.maximum(distances(whole_matrix(b.column(1)), chosen).min(1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["_k", "_v", "d"])

        near = rows.mapInArrow(far, f"_k {rows.schema['_k'].dataType.simpleString()}, _v array<double>, d double")
        total = near.agg(F.sum("d")).first()[0]
        if not total:
            break
        digest = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("_k").cast("string"), F.lit(str(step)), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
        drawn = near.filter(digest / float(1 << 52) < F.col("d") * (oversample * k / total)).orderBy("_k").collect()
        if drawn:
            chosen = np.concatenate([chosen, np.array([r["_v"] for r in drawn])])
    chosen = np.unique(chosen, axis=0)
    if len(chosen) < k:
        return from_buffer(max(k, 3072))(df, key, col, k, seed, distances)
    n, _, _ = code_sums(rows, "_v", chosen, distances=distances)
    return init_kmeanspp(chosen, k, seed, n, distances)


def code_sums(df: DataFrame, col: str, centroids: np.ndarray, prepare=None, distances: Distance = sq_distances) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_k, S_k, Q_k: the sum of squared norms) of the nearest-centroid assignment: a row per code and partition is shuffled, K rows come to the driver. Null vectors count nothing."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k), np.zeros((k, d + 1))
        for b in batches:
            x = whole_matrix(b.column(0))
            if not len(x):
                continue
            x = prepare(x) if prepare else x
            code = nearest(x, centroids, distances)
            n += np.bincount(code, minlength=k)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            s[code[order][starts]] += np.add.reduceat(np.column_stack([x, (x * x).sum(1)])[order], starts, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists(s[used])], names=["code", "n", "s"])

    parts = df.select(F.col(col).cast("array<double>")).mapInArrow(run, "code int, n double, s array<double>")
    n, s = np.zeros(k), np.zeros((k, d + 1))
    for r in sum_rows(parts, "code").collect():
        n[r["code"]], s[r["code"]] = r["n"], r["s"]
    return n, s[:, :d], s[:, d]


def minibatch_update(state: Codebook, n: np.ndarray, s: np.ndarray) -> Codebook:
    """c moves to the batch's mean by n / N, N counting this batch; codes without points stay."""
    counts, c, hit = state.counts + n, state.centroids.copy(), n > 0
    c[hit] -= (c[hit] - s[hit] / n[hit, None]) * (n[hit] / counts[hit])[:, None]
    return Codebook(c, counts)


def minibatch_step(df: DataFrame, col: str, state: Codebook, prepare=None, distances: Distance = sq_distances) -> Codebook:
    return minibatch_update(state, *code_sums(df, col, state.centroids, prepare, distances)[:2])


def minibatch_loss(state: Codebook, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """The loss that a mini-batch step lowers: over the codes it touches, the squared distance of centroid and batch mean times n / N, N counting this batch."""
    hit = n > 0
    gap = ((state.centroids[hit] - s[hit] / n[hit, None]) ** 2).sum(1)
    return float((gap * n[hit] / (state.counts + n)[hit]).sum())


def fit_kmeans(df: DataFrame, key: str, col: str, k: int, max_iter: int = 100, atol: float = 1e-8, buffer: int = 3072, seed: int = 0, init: Initializer | None = None, distances: Distance = sq_distances) -> tuple[Codebook, int]:
    """Steps over all rows from ``init`` (k-means++ of a ``buffer``, if none is given) until no element moves; the codebook and the steps taken."""
    state = (init or from_buffer(buffer))(df, key, col, k, seed, distances)
    df = df.select(key, col).persist()
    try:
        for step in range(1, max_iter + 1):
            new = minibatch_step(df, col, state, distances=distances)
            still, state = np.allclose(new.centroids, state.centroids, atol=atol), new
            if still:
                break
    finally:
        df.unpersist()
    return state, step


def inertia(df: DataFrame, col: str, centroids: np.ndarray, distances: Distance = sq_distances) -> float:
    """The summed distances of all vectors from their nearest centroid."""

    def run(batches):
        for b in batches:
            x = whole_matrix(b.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(distances(x, centroids).min(1).sum())])], names=["d"])

    return df.select(F.col(col).cast("array<double>")).mapInArrow(run, "d double").agg(F.sum("d")).first()[0]
