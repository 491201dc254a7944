"""Residual, multi-level, gradient-moved and rotated codebooks: fits layer by layer, and code tuples in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPS, Distance, is_whole, lists, map_vectors, matrix, nearest, sq_distances, sum_rows, to_orthogonal, whole_matrix
from ..sources.tables import discard, settle
from .kmeans import Codebook, Initializer, code_sums, from_buffer, minibatch_loss, minibatch_update


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)


#: How a layer quantises: ``strategy(given, centroids, numbers, layer)`` tells codes and vectors of what it is given; ``numbers`` are the rows' keys.
Strategy = Callable[[np.ndarray, np.ndarray, np.ndarray | None, int], tuple[np.ndarray, np.ndarray]]


def hard(distances: Distance = sq_distances) -> Strategy:
    """The nearest centroid and itself."""

    def quantise(given, centroids, numbers=None, h=0):
        code = nearest(given, centroids, distances)
        return code, centroids[code]

    return quantise


def soft(temperature: float = 0.7, seed: int = 0, noise: bool = True, distances: Distance = sq_distances) -> Strategy:
    """softmax((noise - distance) / T) weights: the code of the largest, the weighted codebook. Gumbel noise is a counter-based draw for (key, code, seed + layer), made for a whole batch at once."""

    def quantise(given, centroids, numbers, h=0):
        logits = -distances(given, centroids)
        if noise:
            logits = logits - np.log(-np.log(uniform(numbers, len(centroids), seed + h)))
        p = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p @ centroids

    return quantise


def layers(x: np.ndarray, codebooks: list[np.ndarray], normalize: bool = True, residual: bool = True, strategy: Strategy | None = None, numbers: np.ndarray | None = None):
    """(codes, vectors, residual, squared errors) of one layer after the other. A layer quantises the normalised residual but its vector goes from the plain one."""
    r, strategy = x, strategy or hard()
    for h, c in enumerate(codebooks):
        given = unit(r) if normalize else r
        code, vector = strategy(given, c, numbers, h)
        r = r - vector if residual else r
        yield code, vector, r, ((given - vector) ** 2).sum(1)


def walk(x: np.ndarray, codebooks: list[np.ndarray], normalize: bool = True, residual: bool = True, strategy: Strategy | None = None, numbers: np.ndarray | None = None):
    """Codes (N, H), sum of the layers' vectors, residual after the first layer, residual after the last, squared errors summed over layers."""
    r, total, codes, first, errors = x, np.zeros_like(x), [], x, np.zeros(len(x))
    for h, (code, vector, r, error) in enumerate(layers(x, codebooks, normalize, residual, strategy, numbers)):
        errors = errors + error
        codes.append(code)
        total = total + vector
        first = r if h == 0 else first
    return np.array(codes).T.reshape(len(x), -1), total, first, r, errors


def assign_rq(df: DataFrame, key: str, col: str, codebooks: list[np.ndarray], normalize: bool = True, residual: bool = True, distances: Distance = sq_distances, track: bool = False, strategy: Strategy | None = None) -> DataFrame:
    """(key, sid, quantized, first_residual, last_residual, norms: the squared norms of the vector and these residuals, error: the squared errors of what the layers quantise, summed): all layers in one pass, no shuffle. With ``track`` also ``residuals``, those after each layer. A layer takes what is nearest by ``distances``, or what ``strategy`` says. A null vector gives nulls."""
    h, strategy = len(codebooks), strategy or hard(distances)

    def ragged(inner: pa.Array, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h), inner)

    def run(x, numbers):
        codes, total, first, last, error = walk(x, codebooks, normalize, residual, strategy, numbers)
        norms = np.column_stack([(m * m).sum(1) for m in (x, first, last)])
        out = [ragged(pa.array(codes.astype(np.int32).ravel()), len(x)), lists(total), lists(first), lists(last), lists(norms), pa.array(error)]
        if track:
            each = np.stack([r for _, _, r, _ in layers(x, codebooks, normalize, residual, strategy, numbers)], 1)
            out.append(ragged(lists(each.reshape(len(x) * h, -1)), len(x)))
        return out

    kept = ", residuals array<array<double>>" if track else ""
    return map_vectors(df, key, col, f"sid array<int>, quantized array<double>, first_residual array<double>, last_residual array<double>, norms array<double>, error double{kept}", run, numbered=True)


def assignment_loss(assigned: DataFrame, beta: float = 0.25) -> DataFrame:
    """The quantization loss of ``assign_rq``'s rows, summed across layers."""
    return assigned.agg((F.sum("error") * (1 + beta)).alias("loss"))


def fit_rq(df: DataFrame, key: str, col: str, layers: int, k: int, steps: int = 30, normalize: bool = True, residual: bool = True, buffer: int = 3072, seed: int = 0, move=minibatch_update, loss=minibatch_loss, batches: int = 1, init: Initializer | None = None, distances: Distance = sq_distances) -> tuple[list[np.ndarray], list[tuple]]:
    """Codebooks of ``layers`` layers, ``steps // layers`` steps each, and the history (layer, step, loss), the loss before each step.

    What a layer is given is written once, as a table in the shared folder,
    and the table of the layer before deleted; so a step reads and assigns
    the rows of its own layer once, whatever came before, and a lost executor
    costs a read. ``batches`` above 1 takes hash buckets of the rows in turn.
    Without ``residual`` each layer quantises the vector itself (multi-level).
    ``init`` finds each layer's first centroids (k-means++ of a ``buffer``, if
    none is given) and ``distances`` what is nearest. Null vectors count nothing.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("_b")
    vectors = df.select(F.col(key).alias("_k"), bucket, F.col(col).cast("array<double>").alias("_r")).filter(is_whole("_r"))
    codebooks, history, table = [], [], None
    for h in range(layers):
        if h == 0 or residual:
            before, table = table, settle(_next_layer(vectors if table is None else table, codebooks[-1] if h else None, normalize, distances), f"layer-{h}")
            if before is not None:
                discard(before)
        state = (init or from_buffer(buffer))(table, "_k", "_g", k, seed + h, distances)
        for step in range(max(1, steps // layers)):
            part = table.filter(F.col("_b") == step % batches) if batches > 1 else table
            n, s, q = code_sums(part, "_g", state.centroids, distances=distances)
            history.append((h, step, loss(state, n, s, q)))
            state = move(state, n, s)
        codebooks.append(state.centroids)
    discard(table)
    return codebooks, history


def _next_layer(rows: DataFrame, centroids: np.ndarray | None, normalize: bool, distances: Distance) -> DataFrame:
    """(_k, _b, _r, _g): residuals after a layer with these centroids (the vectors themselves, if none) and what the next layer is given."""

    def run(batches):
        for b in batches:
            r = matrix(b.column(2))
            if centroids is not None:
                r = r - centroids[nearest(unit(r) if normalize else r, centroids, distances)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(r), lists(unit(r) if normalize else r)], names=["_k", "_b", "_r", "_g"])

    kind = rows.schema["_k"].dataType.simpleString()
    return rows.select("_k", "_b", "_r").mapInArrow(run, f"_k {kind}, _b int, _r array<double>, _g array<double>")


def gradient_move(lr: float = 0.1, adagrad: bool = True):
    """Moves centroids along the gradient of the quantization loss, 2 (n c - S) / n of all, by plain or Adagrad steps."""
    seen: dict = {}

    def move(state: Codebook, n: np.ndarray, s: np.ndarray) -> Codebook:
        g = 2 * (n[:, None] * state.centroids - s) / max(n.sum(), 1)
        if not state.counts.any():
            seen["sum"] = np.zeros_like(g)
        seen["sum"] = seen["sum"] + g * g
        scale = np.sqrt(seen["sum"]) + 1e-10 if adagrad else 1.0
        return Codebook(state.centroids - lr * g / scale, state.counts + n)

    return move


def quantization_loss(beta: float = 0.25):
    """The loss that gradient steps lower: (1 + beta) times the squared error of all rows to their centroids, from the sums alone."""

    def loss(state: Codebook, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
        c = state.centroids
        return float((1 + beta) * (q.sum() - 2 * (c * s).sum() + (n * (c * c).sum(1)).sum()))

    return loss


def fit_rvq(df: DataFrame, key: str, col: str, layers: int, k: int, steps: int = 30, lr: float = 0.1, adagrad: bool = True, beta: float = 0.25, **options):
    return fit_rq(df, key, col, layers, k, steps, move=gradient_move(lr, adagrad), loss=quantization_loss(beta), **options)


def fit_opq(df: DataFrame, key: str, col: str, layers: int, k: int, iters: int = 4, steps: int = 9, seed: int = 0, **options) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """A rotation W and codebooks of xW^T, by turns: assign and fit, then the orthogonal Procrustes solution from a d x d sum. Also the error of each turn."""
    d = df.select(F.max(F.size(col))).first()[0]
    w, errors, codebooks = np.eye(d), [], None
    rows = df.select(key, F.col(col).cast("array<double>").alias("_v")).filter(is_whole("_v")).persist()
    try:
        for _ in range(iters):
            turned = map_vectors(rows, key, "_v", "_r array<double>", lambda x, w=w: [lists(x @ w.T)])
            new, _ = fit_rq(turned, key, "_r", layers, k, steps, normalize=False, seed=seed, **options)
            xy, error = cross_sums(rows, "_v", w, new)
            if codebooks is not None and error > errors[-1]:
                new = codebooks
                xy, error = cross_sums(rows, "_v", w, new)
            codebooks = new
            errors.append(error)
            u, _, vt = np.linalg.svd(xy)
            w = (u @ vt).T
    finally:
        rows.unpersist()
    return to_orthogonal(w), codebooks, errors


def cross_sums(rows: DataFrame, col: str, w: np.ndarray, codebooks: list[np.ndarray], width: int = 256, tasks: int = 64) -> tuple[np.ndarray, float]:
    """The sum of x^T y over all rows (y: the quantised rotated x), and the squared error of y.

    x and y are written once in blocks of ``width`` columns. For each pair of
    blocks at most ``tasks`` tasks read these two columns and sum one block of
    the matrix (width x width: 0.5 MB at 256, whatever d is), a row of it at a
    time goes to the task that adds up that row of all tasks, and d x (d /
    width) such rows come to the driver.
    """
    d = len(w)
    cuts = [slice(a, min(a + width, d)) for a in range(0, d, width)]
    names = [f"{m}{k}" for m in "xy" for k in range(len(cuts))]

    def split(batches):
        for b in batches:
            x = whole_matrix(b.column(0))
            if not len(x):
                continue
            turned = x @ w.T
            y = walk(turned, codebooks, normalize=False)[1]
            error = ((turned - y) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*[lists(m[:, c]) for m in (x, y) for c in cuts], pa.array(error)], names=[*names, "error"])

    blocks = settle(rows.select(F.col(col).cast("array<double>")).mapInArrow(split, ", ".join(f"{n} array<double>" for n in names) + ", error double"), "blocks")
    found = None
    for i in range(len(cuts)):
        for j in range(len(cuts)):

            def run(batches, i=i, j=j):
                total = 0.0
                for b in batches:
                    total = total + matrix(b.column(0)).T @ matrix(b.column(1))
                if np.ndim(total):
                    at = (cuts[i].start + np.arange(len(total))) * len(cuts) + j
                    padded = np.pad(total, ((0, 0), (0, width - total.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.ones(len(at))), lists(padded)], names=["at", "n", "s"])

            part = blocks.select(f"x{i}", f"y{j}").coalesce(tasks).mapInArrow(run, "at long, n double, s array<double>")
            found = part if found is None else found.unionByName(part)
    m = np.zeros((d, d))
    for r in sum_rows(found, "at").toLocalIterator():
        i, j = divmod(r["at"], len(cuts))
        m[i, cuts[j]] = r["s"][: cuts[j].stop - cuts[j].start]
    error = blocks.agg(F.sum("error")).first()[0]
    discard(blocks)
    return m, float(error or 0.0)


def mixed(h: np.ndarray) -> np.ndarray:
    """32 bits stirred so that each depends on all (the finaliser of MurmurHash3), in 64-bit words."""
    # Its two multipliers.
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(times)) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(16))


def uniform(keys: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """(keys, codes): numbers between 0 and 1 that depend on the key, the code and the seed alone."""
    low, high = (keys.astype(np.int64).view(np.uint64) >> np.uint64(s) & np.uint64(0xFFFFFFFF) for s in (0, 32))
    of_key = mixed(low ^ mixed(high ^ mixed(np.full(len(keys), seed & 0xFFFFFFFF, np.uint64))))
    return (mixed(of_key[:, None] ^ mixed(np.arange(codes, dtype=np.uint64))[None]) + 0.5) / 2.0**32


def assign_soft(df: DataFrame, key: str, col: str, codebook: np.ndarray, temperature: float = 0.7, seed: int = 0, noise: bool = True, distances: Distance = sq_distances) -> DataFrame:
    """(key, code, vector) of one layer by the ``soft`` strategy. A null vector gives nulls."""
    quantise = soft(temperature, seed, noise, distances)

    def run(x, numbers):
        code, vector = quantise(x, codebook, numbers)
        return [pa.array(code.astype(np.int32)), lists(vector)]

    return map_vectors(df, key, col, "code int, vector array<double>", run, numbered=True)


def sid_stats(assigned: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(metric, layer, value) of ``assign_rq``'s rows: share of distinct tuples, of codes used and entropy per layer, mean error, residual shares of the input's norm, norms of the first and last codebook.

    Rows are read once: each adds to its tuple (layer -1) and to its code in
    every layer, and sums per layer of these give all metrics.
    """
    sums = [F.col("norms")[k].alias(n) for k, n in enumerate(("x", "first", "last"))]
    codes = F.transform("sid", lambda c, h: F.struct(h.alias("layer"), F.array(c).alias("code")))
    rows = assigned.select(F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("layer"), F.col("sid").alias("code"))), codes)).alias("c"), *sums, F.size("quantized").alias("width"))
    used = rows.groupBy("c.layer", "c.code").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x", "first", "last", "width")])
    per = used.groupBy("layer").agg(F.count("*").alias("codes"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), *[F.sum(c).alias(c) for c in ("x", "first", "last", "width")])
    each = {"usage": F.col("codes") / len(codebooks[0]), "entropy": F.log("rows") - F.col("n_log_n") / F.col("rows")}
    whole = {"distinct": F.col("codes") / F.col("rows"), "mse": F.col("last") / F.col("width"), "first_share": F.sqrt(F.col("first") / F.col("x")), "last_share": F.sqrt(F.col("last") / F.col("x"))}
    whole |= {f"{name}_codebook_norm": F.lit(float(np.linalg.norm(c))) for name, c in (("first", codebooks[0]), ("last", codebooks[-1]))}
    listed = lambda said: F.array(*[F.struct(F.lit(m).alias("metric"), "layer", v.cast("double").alias("value")) for m, v in said.items()])
    return per.select(F.explode(F.when(F.col("layer") < 0, listed(whole)).otherwise(listed(each))).alias("x")).select("x.*")


def mean_metric(df: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))
