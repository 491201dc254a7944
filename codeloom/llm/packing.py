"""Packing into optimal length buckets.

The global histogram of lengths decides the bucket boundaries by dynamic
programming, so that padding every piece to its bucket's boundary wastes the
fewest tokens that so many buckets can; inside each bucket, batches form up to
a token budget. A text longer than the longest sequence is cut into pieces,
all of which are packed, so the histogram has at most ``max_len`` rows at any
size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle
from .mixing import n_words


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds of least total padding. Ties go to fewer buckets, then to smaller bounds."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.float64)
    c = np.concatenate([[0.0], np.cumsum(counts)])
    t = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    d = len(lengths)
    best = np.full(d + 1, np.inf)
    best[0] = 0.0
    tables = []
    for _ in range(min(buckets, d)):
        now, back = np.full(d + 1, np.inf), np.zeros(d + 1, np.int64)
        for j in range(1, d + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            back[j] = int(np.argmin(cost))
            now[j] = cost[back[j]]
        tables.append((now[d], back))
        best = now
        best[0] = np.inf
    k = int(np.argmin([x for x, _ in tables]))
    out, j = [], d
    for _, back in reversed(tables[: k + 1]):
        out.append(int(lengths[j - 1]))
        j = int(back[j])
    return out[::-1]


def pieces(docs: DataFrame, tokens: Column, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """(_id, piece, start_token, n_tokens, _t: a hash of the text) of each text, at most ``max_len`` tokens each; a text without tokens is one empty piece."""
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_n"))
    count = F.greatest(F.ceil(F.col("_n") / max_len), F.lit(1))
    rows = rows.select("_id", "_t", "_n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.col("piece") * max_len
    return rows.select("_id", "piece", start.alias("start_token"), F.least(F.col("_n") - start, F.lit(max_len)).alias("n_tokens"), "_t")


def pack(docs: DataFrame, tokens: Column | None = None, max_len: int = 2048, buckets: int = 8, token_budget: int = 16384, seed: int = 11, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, ``piece``, ``start_token``, ``n_tokens``, ``bucket``, ``pad_to``, ``batch``, ``row``.

    A batch is (bucket, batch): at most ``token_budget`` padded tokens, one
    piece at least. Every batch of a bucket but the last is full. Pieces go
    into batches in an order by a seeded hash of id, piece and text, ties by id, piece and length. An empty
    piece has a null bucket and batch, so that no document is lost. Null ids
    and repeated rows are packed like others; other columns are ignored.
    """
    cut = settle(pieces(docs, n_words(F.col("text")) if tokens is None else tokens, max_len, id_col), "pieces")
    found = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # max_len + 1 rows at most
    empty = cut.filter("n_tokens = 0").select(F.col("_id").alias(id_col), "piece", "start_token", "n_tokens", *[F.lit(None).cast(t).alias(n) for n, t in (("bucket", "int"), ("pad_to", "long"), ("batch", "long"), ("row", "int"))])
    found.pop(0, None)
    bounds = boundaries(found, buckets)
    if not bounds:
        return empty
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    # about as many shards of a bucket as rows in a shard, whatever the size
    shards = max(1, math.isqrt(sum(found.values())))
    place = F.xxhash64("_id", "piece", F.lit(seed), "_t")  # of the text too: ids may be null or repeat
    rows = cut.filter("n_tokens > 0").withColumn("bucket", bucket).withColumn("_place", place).withColumn("_shard", F.pmod("_place", F.lit(shards)))
    sizes = rows.groupBy("bucket", "_shard").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_place", "_id", "piece", "n_tokens")) - 1
    at = rows.withColumn("_rank", rank).join(offsets, ["bucket", "_shard"]).withColumn("_at", F.col("_rank") + F.col("_offset"))
    pad_to = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(token_budget) / pad_to), F.lit(1))
    packed = at.select(F.col("_id").alias(id_col), "piece", "start_token", "n_tokens", "bucket", pad_to.alias("pad_to"), F.floor(F.col("_at") / room).alias("batch"), (F.col("_at") % room).cast("int").alias("row"))
    return packed.unionByName(empty)


def query(spark, sf_dir):
    from ._shared import table

    return pack(table(spark, sf_dir, "documents"))
