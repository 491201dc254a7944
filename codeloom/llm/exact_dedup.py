"""Exact dedup by skew-safe combining, native.

Rows combine three times, each time by their full content beside its digest:
locally in the task that reads them, then in salted digest groups, then the
salts' winners globally. A group of any size reaches the last step as at most
one row a salt. The winners, one narrow row a text, are settled; every row
then finds its winner by digest in a join that Spark splits where a digest is
hot. Should two texts share a digest, the rows of that digest (only those)
find their winner by full content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, settle


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 16,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are equal when they are after ``normalise``; a null text is an empty
    one. Of equal texts the row with the largest id stays (null ids come last;
    a group of null ids only has a null ``keep_id``). Where several rows bear
    that id, exactly one of them is ``kept``. Other columns are ignored, so
    their names may be anything; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_text").agg(F.max("_id").alias("_top"), F.count("*").alias("_n"))
    winners = salted.groupBy("_digest", "_text").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))
    by_digest = winners.groupBy("_digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("_contents"))
    groups = settle(by_digest)

    clashing = groups.filter("_contents > 1").select("_digest")
    found = _linked(rows.select("_id", "_digest"), groups.filter("_contents = 1").drop("_contents"), ["_digest"])
    if not clashing.isEmpty():
        found = found.unionByName(_linked(rows.join(clashing, "_digest", "left_semi"), winners.join(clashing, "_digest", "left_semi"), ["_digest", "_text"]))
    return found.withColumnsRenamed({"_id": id_col, "_digest": "digest"})


def _linked(rows: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    counted = rows.groupBy("_id", *keys).agg(F.count("*").cast("int").alias("_copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    joined = counted.join(winners, keys).select("_id", "keep_id", "group_size", "_digest", copy)
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return joined.select("_id", "keep_id", "group_size", kept.alias("kept"), "_digest")


def query(spark, sf_dir):
    from ._shared import table

    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
