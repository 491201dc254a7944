"""Row functions over features: rename, select, cast, filter, encode, tokenise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_features(df: DataFrame, feature_map: dict[str, str] | None) -> DataFrame:
    """Only the mapped columns under their new names; sources that are absent are skipped; no map changes nothing."""
    if not feature_map:
        return df
    return df.select(*[F.col(a).alias(b) for a, b in feature_map.items() if a in df.columns])


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), feature_map: dict[str, str] | None = None) -> DataFrame:
    """Rename, then keep the named columns and ``keep``; no names, all columns."""
    df = map_features(df, feature_map)
    return df.select(*[c for c in df.columns if c in features or c in keep]) if features else df


def cast_features(df: DataFrame, type_map: dict[str, str], default: str = "long", only: Sequence[str] | None = None) -> DataFrame:
    """Each feature as an array of its type; a scalar becomes one element. Fractions are cut off by casts to whole types."""
    out = {}
    for f in df.schema.fields:
        if only is None or f.name in only:
            kind = type_map.get(f.name, default)
            out[f.name] = F.col(f.name).cast(f"array<{kind}>") if isinstance(f.dataType, T.ArrayType) else F.array(F.col(f.name).cast(kind))
    return df.withColumns(out)


def decode_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.decode(c, "UTF-8") for c in cols})


def filter_min_length(df: DataFrame, n: int, cols: Sequence[str]) -> DataFrame:
    """Rows none of whose ``cols`` is shorter than ``n``."""
    for c in cols:
        df = df.filter(F.size(c) >= n)
    return df


def filter_non_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return filter_min_length(df, 1, cols)


def encode_category(df: DataFrame, col: str, mapping: DataFrame, oov: int = 0, key: str | None = None) -> DataFrame:
    """``col`` by its index in ``mapping`` (category, index); unknown ones, null among them, are ``oov``. A category with two indexes is an error.

    A list is encoded element by element, in order; that needs ``key``, the
    name of a column whose values are all different.
    """
    one = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("two indexes of category "), F.first("category")))).otherwise(F.first("index"))
    known = mapping.groupBy("category").agg(one.cast("int").alias("_index"))
    if not isinstance(df.schema[col].dataType, T.ArrayType):
        joined = df.join(known.withColumnRenamed("category", "_category"), F.col(col) == F.col("_category"), "left")
        return joined.select(*[F.coalesce("_index", F.lit(oov)).alias(col) if c == col else c for c in df.columns])
    if key is None:
        raise ValueError("a list column needs a key")
    items = df.select(key, F.posexplode(col).alias("_pos", "category")).join(known, "category", "left")
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_index", F.lit(oov)).alias("i")))).alias("_l")).select(key, F.col("_l.i").alias("_l"))
    none = F.when(F.col(col).isNotNull(), F.array().cast("array<int>"))
    return df.join(lists, key, "left").select(*[F.coalesce("_l", none).alias(col) if c == col else c for c in df.columns])


def pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


#: A vocabulary of at most so many tokens travels with the tasks.
MOST_TOKENS = 1_000_000


def tokenize_text(df: DataFrame, key: str, col: str, vocab: DataFrame, max_length: int = 128, pad_id: int = 0, unk_id: int = 1, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``key``, ``ids`` and ``mask`` of fixed length, a row for each row: lower-cased runs of a-z and 0-9, cut to ``max_length``, looked up in ``vocab`` (token, id), padded. A token with two ids is an error; a null text has no words.

    A vocabulary of at most ``most_tokens`` is looked up where the texts are,
    without a shuffle. A larger one is joined: then rows are told apart by
    their key, their words and a number among equal ones.
    """
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), 1, max_length)
    rows = df.select(F.col(key).alias("_key"), words.alias("_w"))
    known = vocab.limit(most_tokens + 1).collect()
    if len(known) <= most_tokens:
        ids = {r["token"]: r["id"] for r in known}
        if len(ids) < len(known):
            raise ValueError("a token has two ids")
        found = _looked_up(rows, ids, unk_id)
    else:
        once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("two ids of token "), F.first("token")))).otherwise(F.first("id"))
        table = vocab.groupBy("token").agg(once.cast("long").alias("id"))
        rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_key", "_w").orderBy(F.lit(0))))
        each = rows.select("_key", "_w", "_row", F.posexplode_outer("_w").alias("pos", "token")).join(table, "token", "left")
        one = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unk_id)).alias("id")))
        found = each.groupBy("_key", "_w", "_row").agg(F.array_sort(F.collect_list(one)).alias("t")).select("_key", F.col("t.id").alias("ids"))
    pad = F.lit(max_length) - F.size("ids")
    return found.select(F.col("_key").alias(key), F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("ids"), F.concat(F.transform("ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), pad)).alias("mask"))


def _looked_up(rows: DataFrame, ids: dict[str, int], unk_id: int) -> DataFrame:
    """(_key, ids) of rows (_key, _w): whole batches of words are looked up at once."""
    tokens = pa.array(list(ids), pa.string())
    numbers = np.array([*ids.values(), unk_id], np.int64)

    def run(batches):
        for b in batches:
            words = b.column(1)
            at = pc.fill_null(pc.index_in(words.flatten(), value_set=tokens), len(tokens)).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[at]))], names=["_key", "ids"])

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, ids array<long>")
