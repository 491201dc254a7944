"""Exact top-k search as a Voronoi kNN join.

Pivots cut queries and data into cells, more of them the more rows there are.
From the cells' summaries (counts, radii) each query cell gets a score that
enough rows are certain to reach for all of its queries; a data cell, and then
a row, is needed only if its bound can reach that score for some query cell.
Query cells are merged into groups, as many as cost least by these bounds: each
group gets only the data that it needs. Groups are solved in blocks of bounded
size and the blocks' best are merged.

Scores are integer inner products of floor(scale * x), exact also beyond the
whole numbers that doubles hold. Vectors that are null or hold null or
non-finite components take no part; shorter vectors count as padded with
zeros. A finite component whose multiple by ``scale`` is none, and a score
among the best that no 64-bit number holds, are errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, settle

#: Pivots at most and at least: the rows with the smallest seeded hashes, as many as the root of all rows between these.
MOST_PIVOTS, LEAST_PIVOTS = 1024, 8
#: Rows of a block: data, queries.
DATA_BLOCK, QUERY_BLOCK = 20_000, 20_000
#: What sending a row to a group costs against scoring it for a query.
SEND_COST = 2000.0
#: Components beyond this take exact Python integers instead of double arithmetic.
EXACT = 2.0**53
LEAST = -(2**62)
MOST = 2**63 - 1


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): the usable vectors as integer-valued doubles in little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = x.values
                if values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if not np.isfinite(v).all():
                    raise ValueError(f"vector {i} holds a component whose {scale}-fold is no finite number")
                ids.append(i)
                out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, v binary")


def _matrix(blobs, width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), width) if len(blobs) else out
    for k, b in enumerate(blobs):
        out[k, : len(b) // 8] = np.frombuffer(b, np.float64)
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where all sums stay below 2^53, else in Python's integers."""
    if not q.size or not x.size or np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max() < EXACT / 2 / (1 << 16):
        return (q @ x.T).astype(np.int64)
    return _ints(q).dot(_ints(x).T)


def _ints(m: np.ndarray) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape)


def _top(scores: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, score) of each query's k best but itself, ties to smaller ids. The columns of ``scores`` go by id."""
    n = scores.shape[1]
    if scores.dtype == object:
        rows = [(r, c) for r in range(len(q_ids)) for c in sorted((c for c in range(n) if x_ids[c] != q_ids[r]), key=lambda c: (-scores[r, c], x_ids[c]))[:k]]
        r, c = (np.array(v, np.int64) for v in (zip(*rows, strict=True) if rows else ([], [])))
        return r, c, scores[r, c]
    # one number for score and id, all different: a larger one is better
    key = scores * n + (n - 1 - np.arange(n))
    key[x_ids[None, :] == q_ids[:, None]] = LEAST
    cols = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(q_ids), 1))
    r = np.repeat(np.arange(len(q_ids)), cols.shape[1])
    c = cols.ravel()
    ok = key[r, c] != LEAST
    return r[ok], c[ok], scores[r[ok], c[ok]]


def plan_groups(p: np.ndarray, cells: list, k: int, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each pivot or -1, reach of each query cell, its radius, which pivots' cells each group needs).

    ``cells`` has a row (cell, n, far, nq, q_far) per pivot with rows; all
    bounds follow from <q, x> with q and x within their radii of their pivots.
    ``copies`` rows at most bear a query's own id and do not count for it.
    """
    n_p, slack = len(p), 1e-6
    n, far, nq, q_far = (np.zeros(n_p) for _ in range(4))
    for c in cells:
        n[c["cell"]], far[c["cell"]], nq[c["cell"]], q_far[c["cell"]] = c["n"], c["far"] * (1 + slack), c["nq"] or 0, (c["q_far"] or 0.0) * (1 + slack)
    asks = np.flatnonzero(nq > 0)
    norm = np.linalg.norm(p, axis=1)
    dot, room = p[asks] @ p.T, np.outer(q_far[asks], norm) + np.outer(norm[asks], far) + np.outer(q_far[asks], far)
    reach = np.full(n_p, -math.inf)
    for row, a in enumerate(asks):
        low = dot[row] - room[row]
        order = np.argsort(-low)
        sure = np.cumsum(n[order])
        at = int(np.searchsorted(sure, k + copies))
        if at < n_p:
            reach[a] = low[order[at]] - slack * (1 + abs(low[order[at]]))
    needs = (dot + room >= reach[asks][:, None]) & (n > 0)
    # groups by farthest pivots, 1, 2, 4, ... of them; the cheapest number
    best, best_cost = None, math.inf
    centres, gap = [], np.full(len(asks), np.inf)
    of = np.zeros(len(asks), np.int64)
    size = 1
    while len(asks):
        while len(centres) < min(size, len(asks)):
            new = int(gap.argmax()) if centres else 0
            d = ((p[asks] - p[asks[new]]) ** 2).sum(1)
            of[d < gap] = len(centres)
            gap = np.minimum(gap, d)
            centres.append(new)
        kept = np.zeros((len(centres), n_p), bool)
        np.logical_or.at(kept, of, needs)
        rows, asked = kept @ n, np.bincount(of, nq[asks], len(centres))
        cost = float((SEND_COST * rows * np.ceil(asked / QUERY_BLOCK) + rows * asked).sum())
        if cost < best_cost:
            best, best_cost = (of.copy(), kept), cost
        if size >= len(asks):
            break
        size *= 2
    group = np.full(n_p, -1)
    if best is None:
        return group, reach, q_far, np.zeros((0, n_p), bool)
    group[asks] = best[0]
    return group, reach, q_far, best[1]


def deal(rows: DataFrame, p: np.ndarray, plan: tuple, q_blocks: list[int], blocks: list[int]) -> DataFrame:
    """(grp, qb, db, vec_id, v): the rows (vec_id, cell, norm, v) that each group needs, once per block of its queries."""
    group, reach, radius, kept = plan
    width, slack = p.shape[1], 1e-6
    wanted = np.flatnonzero(kept.any(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks = np.flatnonzero(group >= 0)
        for b in batches:
            x = _matrix(list(b["v"]), width)
            norm, cell = b["norm"].to_numpy(), b["cell"].to_numpy()
            spread = b["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            near = x @ p[asks].T + radius[asks][None, :] * norm[:, None] * (1 + slack) + slack >= reach[asks][None, :]
            for g in range(len(kept)):
                some = np.flatnonzero(kept[g][cell] & near[:, group[asks] == g].any(1))
                for qb in range(q_blocks[g] if len(some) else 0):
                    yield pd.DataFrame({"grp": g, "qb": qb, "db": (spread[some] % np.uint64(blocks[g])).astype(np.int64), "vec_id": b["vec_id"].to_numpy()[some], "v": b["v"].to_numpy()[some]})

    some = rows if len(wanted) == len(p) else rows.filter(F.col("cell").isin(*map(int, wanted)))
    return some.select("vec_id", "cell", "norm", "v").mapInPandas(run, "grp int, qb int, db long, vec_id long, v binary")


def prepare(df: DataFrame, is_query: str, k: int, id_col: str, vec_col: str, scale: int, pivots: int | None) -> tuple | None:
    """The rows by cell, the pivots, the plan, and each group's numbers of query blocks and of data blocks, by the rows of the cells it needs; None if there is nothing to ask."""
    data = settle(quantise(df, id_col, vec_col, scale), "vectors")
    total, width = data.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    count = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(total)))
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()  # a bounded number of rows
    if not chosen:
        return None
    width //= 8
    p = np.unique(_matrix([bytes(r["v"]) for r in chosen], width), axis=0)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(list(b["v"]), width)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :], 0))
            cell = d.argmin(1)
            exact = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pd.DataFrame({"vec_id": b["vec_id"], "cell": cell, "far": exact, "norm": np.linalg.norm(x, axis=1), "v": b["v"]})

    rows = settle(data.mapInPandas(cells, "vec_id long, cell int, far double, norm double, v binary").withColumn("q", F.coalesce(F.expr(is_query), F.lit(False))).sortWithinPartitions("cell"), "cells")
    discard(df.sparkSession, data)
    said = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(F.when(F.col("q"), F.col("far"))).alias("q_far")).collect()  # a row per pivot
    copies = rows.filter("q").groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if copies is None:
        return None
    plan = plan_groups(p, said, k, copies)
    asked = np.bincount(plan[0][[s["cell"] for s in said if s["nq"]]], [s["nq"] for s in said if s["nq"]], len(plan[3]))
    needed = plan[3] @ np.bincount([s["cell"] for s in said], [s["n"] for s in said], len(p))
    return rows, p, plan, *([max(1, math.ceil(n / size)) for n in of] for of, size in ((asked, QUERY_BLOCK), (needed, DATA_BLOCK)))


def ask(rows: DataFrame, plan: tuple, q_blocks: list[int], blocks: list[int]) -> DataFrame:
    """(grp, qb, db, vec_id, qh, v): each query once per block of its group's data."""
    group = F.element_at(F.array(*[F.lit(int(g)) for g in plan[0]]), F.col("cell") + 1)
    of = lambda n: F.element_at(F.array(*map(F.lit, n)), F.col("grp") + 1)
    asked = rows.filter("q").dropDuplicates(["vec_id", "v"]).withColumn("grp", group)
    return asked.select("grp", F.pmod(F.xxhash64("vec_id"), of(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), of(blocks).cast("long") - 1)).alias("db"), "vec_id", F.xxhash64("v").alias("qh"), "v")


def knn_join(df: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies the SQL condition ``is_query`` on ``vec_id``, its k best others, ties to smaller ids.

    Rows that bear the query's id never match it; rows that repeat another id
    match once each; of rows that repeat a query's id, each vector asks once.
    Null ids and unusable vectors take no part; other columns are ignored. An
    empty table, or one without usable vectors, gives an empty result.
    """
    found = prepare(df, is_query, k, id_col, vec_col, scale, pivots)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, p, plan, q_blocks, blocks = found
    width = p.shape[1]
    dealt = deal(rows, p, plan, q_blocks, blocks)
    asked = ask(rows, plan, q_blocks, blocks)

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = x.sort_values("vec_id", kind="stable")
        x_ids, xm = x["vec_id"].to_numpy(), _matrix(list(x["v"]), width)
        for a in range(0, len(q) if len(x) else 0, 256):
            some = q.iloc[a : a + 256]
            ids = some["vec_id"].to_numpy()
            scores = _scores(_matrix(list(some["v"]), width), xm)
            r, c, s = _top(scores, ids, x_ids, k)
            if s.dtype == object and any(abs(x) > MOST for x in s):
                raise ValueError(f"a score of query {ids[r[[abs(x) > MOST for x in s]]][0]} is no 64-bit number")
            out.append(pd.DataFrame({"query_id": ids[r], "qh": some["qh"].to_numpy()[r], "vec_id": x_ids[c], "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "qh", "vec_id", "score")})

    keys = ["grp", "qb", "db"]
    best = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(solve, "query_id long, qh long, vec_id long, score long")
    # a query's k best of every block: few rows, combined before they are ranked
    order = F.struct((-F.col("score")).alias("down"), "vec_id")
    merged = best.groupBy("query_id", "qh").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))


def query(spark, sf_dir):
    from ._shared import table

    return knn_join(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id != e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
