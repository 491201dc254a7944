"""Code tables: collision digits, transposes, shapes, prefixes, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_sids(sids: DataFrame, shard_bits: int = 8) -> DataFrame:
    """(item_id, sid, digit): 0 where a tuple is unique, else 1, 2, ... by item id within the tuple.

    A tuple's items are numbered in ranges of ids, by two levels, so that a
    tuple which very many items share is not one task's work: ranks within a
    range, plus the sizes of the ranges before.
    """
    lo, hi = sids.agg(F.min("item_id"), F.max("item_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // (1 << shard_bits) + 1)
    rows = sids.withColumn("_r", F.floor((F.col("item_id") - F.lit(lo or 0)) / width))
    sizes = rows.groupBy("sid", "_r").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("sid")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("sid", "_r", before.alias("_before"), F.sum("_n").over(by).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("sid", "_r").orderBy("item_id"))
    joined = rows.withColumn("_rank", rank).join(offsets, ["sid", "_r"])
    return joined.select("item_id", "sid", F.when(F.col("_all") == 1, 0).otherwise(F.col("_rank") + F.col("_before")).cast("int").alias("digit"))


def transpose_sids(sids: DataFrame) -> DataFrame:
    return sids.select(F.posexplode("sid").alias("hierarchy", "code"), "item_id").select("hierarchy", "item_id", "code")


def sid_shape(sids: DataFrame) -> DataFrame:
    return sids.agg(F.max(F.size("sid")).alias("hierarchies"), (F.max(F.array_max("sid")) + 1).alias("codebook_size"))


def valid_prefix(prefixes: DataFrame, sids: DataFrame) -> DataFrame:
    """``prefixes`` with ``valid``: some item's tuple starts with the prefix."""
    known = sids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("sid")), lambda h: F.slice("sid", F.lit(1), h))).alias("prefix")).distinct()
    return prefixes.join(known.withColumn("_ok", F.lit(True)), "prefix", "left").select(*prefixes.columns, F.coalesce("_ok", F.lit(False)).alias("valid"))


def resolve(preds: DataFrame, sids: DataFrame) -> DataFrame:
    return preds.join(sids.select("sid", "item_id"), "sid")
