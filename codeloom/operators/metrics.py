"""Candidates and their evaluation: matches, NDCG, recall, retrieval, comparison of runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, lists, matrix, whole, whole_matrix
from ..sources.tables import settle


@dataclass(frozen=True)
class Metric:
    """A ranking metric at K: ``term(rank, hit)`` of each candidate up to K, brought together by ``gather``, and ``finish(gathered, positives, k)`` of a user."""

    term: Callable[[Column, Column], Column]
    finish: Callable[[Column, Column, int], Column]
    gather: Callable[[Column], Column] = F.sum


def _ideal(most: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))


NDCG = Metric(lambda rank, hit: hit / F.log2(rank + 1), lambda got, positives, k: F.when(positives > 0, got / _ideal(F.least(positives, F.lit(k)))).otherwise(0.0))
RECALL = Metric(lambda rank, hit: hit, lambda got, positives, k: got / F.greatest(F.least(positives, F.lit(k)), F.lit(1)))
#: The reciprocal rank of the first hit.
MRR = Metric(lambda rank, hit: hit / rank, lambda got, positives, k: got.cast("double"), F.max)
METRICS: dict[str, Metric] = {"ndcg": NDCG, "recall": RECALL}


def match_labels(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """``preds`` with ``target``: all digits equal the user's label."""
    joined = preds.join(labels.select("user_id", F.col("sid").alias("_label")), "user_id", "left")
    return joined.select(*preds.columns, F.coalesce(F.col("sid") == F.col("_label"), F.lit(False)).alias("target"))


def per_user(cands: DataFrame, ks: Sequence[int], key: str = "user_id", metrics: Mapping[str, Metric] = METRICS) -> DataFrame:
    """(key, name_k of each metric) from (key, pos, score, target): one ranking, by score, then position, serves all K. The ideal ranking and the positives are those among the candidates."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    rows = cands.withColumn("_rank", rank).withColumn("_hit", F.col("target").cast("int"))
    named = [(f"{m}_{k}", metric, k) for k in ks for m, metric in metrics.items()]
    inside = lambda metric, k: F.when(F.col("_rank") <= k, metric.term(F.col("_rank"), F.col("_hit"))).otherwise(0)
    users = rows.groupBy(key).agg(F.sum("_hit").alias("_positives"), *[metric.gather(inside(metric, k)).alias(f"_{name}") for name, metric, k in named])
    return users.select(key, *[metric.finish(F.col(f"_{name}"), F.col("_positives"), k).alias(name) for name, metric, k in named])


def ndcg(cands: DataFrame, k: int) -> DataFrame:
    return per_user(cands, [k], metrics={"ndcg": NDCG})


def recall(cands: DataFrame, k: int) -> DataFrame:
    return per_user(cands, [k], metrics={"recall": RECALL})


def evaluate(cands: DataFrame, ks: Sequence[int] = (5, 10), metrics: Sequence[str] | Mapping[str, Metric] = ("ndcg", "recall"), key: str = "user_id") -> DataFrame:
    """One row: the mean of each metric@k over users, 0 without users. Metrics are names of ``METRICS`` or a mapping of names to metrics of one's own."""
    metrics = metrics if isinstance(metrics, Mapping) else {m: METRICS[m] for m in metrics}
    users = per_user(cands, ks, key, metrics)
    return users.agg(*[F.coalesce(F.avg(f"{m}_{k}"), F.lit(0.0)).alias(f"{m}_{k}") for m in metrics for k in ks], F.count("*").alias("users"))


#: Bytes of the vectors of one side that a task of ``retrieve_all`` holds, at most, and the most norm bands.
BLOCK_BYTES, BANDS = 1 << 26, 64
#: Keys and queries that a task scores at once.
KEYS_AT_ONCE, QUERIES_AT_ONCE = 512, 256
#: Scores are compared at so many decimals; bounds give way by more than that.
DECIMALS, SLACK = 9, 1e-8


@dataclass
class Retrieval:
    """What ``retrieval`` found, and how many of the pairs of query and key it scored (counted when asked for)."""

    found: DataFrame
    raw: DataFrame
    pairs: int

    def met(self) -> int:
        return self.raw.agg(F.sum("met")).first()[0] or 0


def _normed(rows: DataFrame, name: str) -> DataFrame:
    """(name, vec, norm) of the rows (id, vec) whose vectors are whole, computed once."""

    def run(batches):
        for b in batches:
            mask = whole(b.column(1))
            m = whole_matrix(b.column(1))
            ids = b.column(0) if mask is None else b.column(0).filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([ids, lists(m), pa.array(np.linalg.norm(m, axis=1))], names=[name, "vec", "norm"])

    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.select("id", F.col("vec").cast("array<double>")).mapInArrow(run, f"{name} {kind}, vec array<double>, norm double"), name)


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best keys of each query of one block in another, none below the query's threshold, and how many keys it was scored with.

    Keys go by falling norm, some at a time; a query that their largest norm
    cannot lift to its k-th best score so far is done.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": left.column("query_id").slice(0, 0), "key_id": right.column("key_id").slice(0, 0), "score": pa.array([], pa.float64()), "met": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("key_id")  # a key's place tells ties
        m, norm = matrix(right.column("vec").combine_chunks()), right.column("norm").to_numpy()
        place = np.argsort(-norm, kind="stable")
        m, norm = m[place], norm[place]
        x, x_norm, least = matrix(left.column("vec").combine_chunks()), left.column("norm").to_numpy(), left.column("least").to_numpy().copy()
        if x.shape[1] != m.shape[1]:
            raise ValueError("vectors have unequal widths")
        met, out = np.zeros(len(x), np.int64), []
        for a in range(0, len(x), QUERIES_AT_ONCE):
            rows = np.arange(a, min(a + QUERIES_AT_ONCE, len(x)))
            held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query, score, key's place; by query, then falling score, then place
            for c in range(0, len(m), KEYS_AT_ONCE):
                rows = rows[x_norm[rows] * norm[c] * (1 + 1e-9) + SLACK >= least[rows]]
                if not len(rows):
                    break
                s = np.round(x[rows] @ m[c : c + KEYS_AT_ONCE].T, DECIMALS)
                met[rows] += s.shape[1]
                bar = least[rows] - SLACK
                if s.shape[1] > k:
                    bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
                i, j = np.nonzero(s >= bar[:, None])
                q, score, key = (np.concatenate(z) for z in zip(held, (rows[i], s[i, j], place[c + j]), strict=True))
                order = np.lexsort((key, -score, q))
                q, score, key = q[order], score[order], key[order]
                begin = np.flatnonzero(np.diff(q, prepend=-1))
                rank = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
                held = tuple(z[rank < k] for z in (q, score, key))
                last = rank == k - 1
                least[q[last]] = np.maximum(least[q[last]], score[last])
            out.append(held)
        q, score, key = (np.concatenate(z) for z in zip(*out, strict=True))
        kept = score >= least[q] - SLACK
        q, score, key = q[kept], score[kept], key[kept]
        # each query's first row tells how many keys it met; one without rows has an empty one for that
        first = np.diff(q, prepend=-1) != 0
        none = np.setdiff1d(np.arange(len(x)), q)
        asked, keys = left.column("query_id").combine_chunks(), right.column("key_id").combine_chunks()
        found = pa.table({"query_id": asked.take(pa.array(q)), "key_id": keys.take(pa.array(key)), "score": pa.array(score), "met": pa.array(np.where(first, met[q], 0))})
        blank = pa.table({"query_id": asked.take(pa.array(none)), "key_id": pa.nulls(len(none), keys.type), "score": pa.nulls(len(none), pa.float64()), "met": pa.array(met[none])})
        return pa.concat_tables([found, blank])

    return run


def retrieval(queries: DataFrame, keys: DataFrame, k: int, block: int | None = None, bands: int = BANDS) -> Retrieval:
    """The k keys (id, vec) of the largest dot products with each query (id, vec), ties to the smaller id, exactly, with the keys' norms as bounds.

    Keys are cut into bands of falling norm, bands into blocks as large as a
    task holds (``BLOCK_BYTES``, at least 4 k rows; ``block`` rows, if given).
    All queries meet one block of the longest keys first; the k-th best score
    there is a threshold that a key can only reach if its norm times the query's
    does, so a query goes on to the blocks of the first few bands alone, and in
    each block only to the first of its keys. Queries that go equally far share
    blocks of queries, and a block of keys goes only to those that need it.
    Driver and plan know bands and counts, never rows.

    Null vectors take no part; unequal widths are an error; norms that are
    all equal bound nothing, then every query meets every key.
    """
    x, q = _normed(keys, "key_id"), _normed(queries, "query_id")
    n, width = x.agg(F.count("*"), F.max(F.size("vec"))).first()
    block = max(4 * k, min(block or n, BLOCK_BYTES // (8 * (width or 1))))
    many = max(1, min(bands, -(-n // block)))
    cuts = x.agg(F.percentile_approx("norm", [1 - b / many for b in range(1, many)], 100 * many)).first()[0] if many > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c > F.col("norm"))) if cuts else F.lit(0)
    x = x.withColumn("band", band)
    size = {r["band"]: (r["n"], r["most"]) for r in x.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}  # a row a band
    known = sorted(size)
    parts = {b: -(-size[b][0] // block) for b in known}
    ends = dict(zip(known, np.cumsum([parts[b] for b in known]).tolist(), strict=True))
    pick = lambda of: F.element_at(F.create_map(*[F.lit(v) for b in known for v in (b, of[b])]), F.col("band")) if known else F.lit(0)
    x = x.withColumn("blk", (pick(ends) - 1 - F.pmod(F.xxhash64("key_id"), pick(parts))).cast("int"))

    best = _best(k)
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, key_id {keys.schema['id'].dataType.simpleString()}, score double, met long"
    asked = q.count()
    first = ends[known[0]] - 1 if known else 0
    # no fewer blocks of queries than tasks that run at once, where there are rows for them
    dealt = max(1, -(-asked // block), min(queries.sparkSession.sparkContext.defaultParallelism, asked // QUERIES_AT_ONCE))
    left = q.select("query_id", "vec", "norm", F.lit(float("-inf")).alias("least"), F.pmod(F.xxhash64("query_id"), F.lit(dealt)).cast("int").alias("qb"))
    right = x.filter(F.col("blk") == first).select("key_id", "vec", "norm", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("qb"))
    met_first = settle(left.groupBy("qb").cogroup(right.groupBy("qb")).applyInArrow(best, kinds), "first-block")
    if sum(parts.values()) < 2:
        return Retrieval(_ranked(met_first, k), met_first, asked * n)

    threshold = met_first.filter("key_id IS NOT NULL").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    q = q.join(threshold.select("query_id", "least"), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    reach = [F.col("norm") * size[b][1] * (1 + 1e-9) + SLACK >= F.col("least") for b in known]  # true for the first few
    far = F.lit(0)
    for c in reach:
        far = far + c.cast("int")
    q = settle(q.withColumn("far", far), "bounded")
    counts = {r["far"]: r["n"] for r in q.groupBy("far").agg(F.count("*").alias("n")).collect()}  # a row a band
    upto = {f: ends[known[f - 1]] if f else 0 for f in counts}
    # blocks of queries, those that go furthest first; a key of band b goes to those that go beyond it
    shares = {f: -(-c // block) for f, c in counts.items()}
    base, total, wanted = {}, 0, {}
    for f in sorted(counts, reverse=True):
        base[f] = total
        total += shares[f]
    for at, b in enumerate(known):
        wanted[b] = sum(shares[f] for f in counts if f > at)
    chosen = lambda of: F.element_at(F.create_map(*[F.lit(v) for f in of for v in (f, of[f])]), F.col("far"))
    rows = q.filter(F.col("far") > 0).withColumn("qb", (chosen(base) + F.pmod(F.xxhash64("query_id"), chosen(shares))).cast("int"))
    left = rows.select("query_id", "vec", "norm", "least", "qb", F.explode(F.sequence(F.lit(0), chosen(upto) - 1)).alias("blk")).filter(F.col("blk") != first)
    right = x.filter((F.col("blk") != first) & (pick(wanted) > 0)).select("key_id", "vec", "norm", "blk", F.explode(F.sequence(F.lit(0), pick(wanted) - 1)).alias("qb"))
    raw = met_first.unionByName(left.groupBy("blk", "qb").cogroup(right.groupBy("blk", "qb")).applyInArrow(best, kinds))
    return Retrieval(_ranked(raw, k), raw, asked * n)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id"))
    found = found.filter("key_id IS NOT NULL")
    return found.withColumn("pos", rank).filter(F.col("pos") <= k).select("query_id", "pos", "key_id", "score")


def retrieve_all(queries: DataFrame, keys: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(query_id, pos, key_id, score) of ``retrieval``."""
    return retrieval(queries, keys, k, block).found


def seeded_id(query: Column, i: Column, seed: int, low: int, high: int) -> Column:
    digest = F.md5(F.concat_ws("-", query.cast("string"), i.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low) + low


def sample_negatives(queries: DataFrame, keys: DataFrame, n: int = 500, buffer: int = 100, seed: int = 0) -> DataFrame:
    """(query_id, pos, key_id, score, target): the positive at position 0 and ``n`` ids drawn with replacement from [buffer, N); queries are (id, vec, positive), keys (id, vec)."""
    total = keys.count()
    drawn = queries.select(F.col("id").alias("query_id"), "vec", "positive", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("pos"))
    key = F.when(F.col("pos") == 0, F.col("positive")).otherwise(seeded_id(F.col("query_id"), F.col("pos"), seed, buffer, total))
    joined = drawn.withColumn("key_id", key).join(keys.select(F.col("id").alias("key_id"), F.col("vec").alias("_key")), "key_id")
    return joined.select("query_id", "pos", "key_id", dot("vec", "_key").alias("score"), (F.col("key_id") == F.col("positive")).alias("target"))


def evaluate_retrieval(queries: DataFrame, keys: DataFrame, ks: Sequence[int] = (5, 10), sampled: int | None = None, buffer: int = 100, seed: int = 0) -> DataFrame:
    """``evaluate`` over all keys, or over ``sampled`` negatives; queries are (id, vec, positive)."""
    if sampled is not None:
        cands = sample_negatives(queries, keys, sampled, buffer, seed)
    else:
        found = retrieve_all(queries, keys, max(ks))
        cands = found.join(queries.select(F.col("id").alias("query_id"), "positive"), "query_id").withColumn("target", F.col("key_id") == F.col("positive"))
    return evaluate(cands, ks, key="query_id")


def compare_runs(metrics: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A row per (dataset, method), a column per metric."""
    return metrics.groupBy("dataset", "method").pivot("metric", list(names) if names else None).agg(F.first("value"))


def best_run(metrics: DataFrame, monitor: str = "val/recall@5", mode: str = "max") -> DataFrame:
    """The run of each dataset with the best monitored value, ties to the earliest step, then the method's name."""
    value = F.col("value") if mode == "min" else -F.col("value")
    best = F.min(F.struct(value.alias("v"), "step", "method"))
    rows = metrics.filter(F.col("metric") == monitor).groupBy("dataset").agg(best.alias("b"))
    return rows.select("dataset", F.col("b.method").alias("method"), F.col("b.step").alias("step"), (F.col("b.v") if mode == "min" else -F.col("b.v")).alias("value"))
