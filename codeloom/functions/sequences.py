"""Sequence operators: item histories to code tokens, windows, labels, masks. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_sid_tokens(seqs: DataFrame, sids: DataFrame, key: str, col: str, num_hierarchies: int | None = None, on_missing: str = "error") -> DataFrame:
    """``key`` and ``tokens``: each item's code tuple, in order, flattened; only the first ``num_hierarchies`` digits if given. Unknown items are an error or, with ``drop``, left out."""
    digits = F.col("sid")
    if num_hierarchies is not None:
        if sids.filter(F.size("sid") < num_hierarchies).limit(1).count():
            raise ValueError("a code tuple has fewer digits than asked for")
        digits = F.slice("sid", 1, num_hierarchies)
    items = seqs.select(key, F.posexplode(col).alias("pos", "item_id"))
    joined = items.join(sids.select("item_id", digits.alias("sid")), "item_id", "left")
    if on_missing == "error":
        joined = joined.withColumn("sid", F.when(F.col("sid").isNull(), F.raise_error(F.concat(F.lit("no code for item "), F.col("item_id").cast("string")))).otherwise(F.col("sid")))
    rows = joined.filter("sid IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sid"))).alias("s"))
    return rows.select(key, F.flatten("s.sid").alias("tokens"))


def attach_embedding(df: DataFrame, embeddings: DataFrame, id_col: str, out_col: str) -> DataFrame:
    return df.join(embeddings.select(F.col("item_id").alias(id_col), F.col("embedding").alias(out_col)), id_col)


def trim(col, n: int, left: bool = True) -> Column:
    """The last ``n`` (cutting on the left) or first ``n`` elements; shorter arrays are unchanged."""
    return F.when(F.size(col) > n, F.slice(col, -n, n) if left else F.slice(col, 1, n)).otherwise(F.col(col) if isinstance(col, str) else col)


def drop_token(col, oov: int | None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col if oov is None else F.filter(col, lambda x: x != oov)


def pad_or_trim(col, n: int, pad: int) -> Column:
    """The last ``n`` tokens, padded on the right."""
    kept = trim(col, n)
    return F.concat(kept, F.array_repeat(F.lit(pad).cast("long"), F.lit(n) - F.size(kept)))


def attention_mask(col, pad: int) -> Column:
    return F.transform(col, lambda x: (x != pad).cast("int"))


def contiguous_subsequences(df: DataFrame, col: str, step: int = 1) -> DataFrame:
    """(start, end) of every window of two items or more, ends rising, then starts; ``window`` cuts it."""
    items = (F.size(col) / step).cast("int")
    ends = df.filter(items >= 2).withColumn("end", F.explode(F.sequence(F.lit(2), items)))
    return ends.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("end") - 2)))


def window(col: str, step: int = 1) -> Column:
    return F.slice(col, F.col("start") * step + 1, (F.col("end") - F.col("start")) * step)


def sample_augmented(df: DataFrame, group: list[str], max_rows: int, seed: int, key: list[str]) -> DataFrame:
    """At most ``max_rows`` rows of each group, those with the least seeded digests of their ``key``. It reads every row of a group; windows are drawn without making them by ``draw_windows`` and ``draw_group_windows``."""
    order = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order, *key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= max_rows).drop("_rank")


def _bounds(df: DataFrame, t: Column) -> DataFrame:
    """``df`` with (start, end) of window number ``t`` of a row; windows are numbered by rising end, then start."""
    # number t has end - 2 = m, the largest m with m (m + 1) / 2 <= t; the root may be off by one
    rows = df.withColumn("_t", t).withColumn("_m", F.floor((F.sqrt(F.col("_t") * 8.0 + 1) - 1) / 2))
    rows = rows.withColumn("_m", F.expr("CASE WHEN _m * (_m + 1) div 2 > _t THEN _m - 1 WHEN (_m + 1) * (_m + 2) div 2 <= _t THEN _m + 1 ELSE _m END"))
    return rows.withColumn("start", F.expr("CAST(_t - _m * (_m + 1) div 2 AS INT)")).withColumn("end", F.expr("CAST(_m + 2 AS INT)")).drop("_t", "_m")


def _numbers(of: str, total: str, max_rows: int, seed: int) -> Column:
    """All numbers below ``total`` if there are at most ``max_rows``; else so many draws with replacement from digests of ``of``, the draw and the seed, repeats left out."""
    said = lambda i: F.substring(F.md5(F.concat_ws("-", F.col(of).cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 15)
    draw = lambda i: F.when(F.col(total) <= max_rows, i.cast("long")).otherwise(F.conv(said(i), 16, 10).cast("long") % F.col(total))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(total, F.lit(max_rows)).cast("int") - 1), draw))


def _with_counts(df: DataFrame, col: str, step: int) -> DataFrame:
    """``df`` with ``_n``, the number of windows; null and empty histories have none."""
    items = F.greatest((F.size(col) / step).cast("int").cast("long"), F.lit(0))
    return df.withColumn("_items", items).withColumn("_n", F.expr("_items * (_items - 1) div 2")).drop("_items")


def draw_windows(df: DataFrame, key: str, col: str, step: int, max_rows: int, seed: int) -> DataFrame:
    """``df`` with (start, end) of windows of two items or more: all of them if there are at most ``max_rows``, else as many draws with replacement, repeats left out.

    Windows are numbered by rising end, then start, and draws are numbers from
    a digest of ``key``, the draw and the seed, so no window is made that is
    not kept, and nothing is shuffled.
    """
    rows = _with_counts(df, col, step).filter("_n > 0").withColumn("_draw", F.explode(_numbers(key, "_n", max_rows, seed)))
    return _bounds(rows, F.col("_draw")).drop("_n", "_draw")


def draw_group_windows(df: DataFrame, key: str, col: str, step: int, group_size: int, max_rows: int, seed: int, shards: int = 4096) -> DataFrame:
    """``df`` with ``group`` and (start, end) of windows drawn from groups of ``group_size`` rows together, as a training loader draws them from a batch: all windows of a group if there are at most ``max_rows``, else as many draws with replacement over all of them, repeats left out.

    Rows are grouped in the order of a seeded digest of ``key``, whose values
    are all different. A group's windows are numbered through its rows in
    that order: the numbers before a row are a prefix sum of k (k - 1) / 2,
    which comes from sums within ranges of digests and of the ranges before.
    A draw is a number; merged with the rows by number, it belongs to the row
    last before it. Only keys and numbers are sorted; histories meet the
    draws of their own row once, and no window is made that is not kept.
    """
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    rows = _with_counts(df, col, step).select(key, "_n", digest.alias("_d"))
    rows = rows.withColumn("_r", (F.conv(F.substring("_d", 1, 8), 16, 10).cast("long") * shards / (1 << 32)).cast("int"))
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_r").agg(F.count("*").alias("_rows"), F.sum("_n").alias("_sum"))
    ranges = ranges.select("_r", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(to) for c, to in (("_rows", "_rows0"), ("_sum", "_sum0"))])  # a row per range
    inside = Window.partitionBy("_r").orderBy("_d", key)
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    rows = rows.withColumn("_place", F.row_number().over(inside) - 1).withColumn("_upto", upto).join(F.broadcast(ranges), "_r")
    rows = rows.select(key, "_n", F.expr(f"(_place + _rows0) div {group_size}").alias("group"), (F.col("_upto") + F.col("_sum0")).alias("_first"))
    groups = rows.groupBy("group").agg(F.min("_first").alias("_base"), F.sum("_n").alias("_total")).filter("_total > 0")
    drawn = groups.select("group", F.explode(_numbers("group", "_total", max_rows, seed)).alias("_t"), "_base")
    owner = F.struct(F.col(key).alias("key"), F.col("_first").alias("first"))
    marks = rows.filter("_n > 0").select("group", F.col("_first").alias("_at"), F.lit(0).alias("_kind"), owner.alias("_row"))
    asked = drawn.select("group", (F.col("_t") + F.col("_base")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"))
    last = F.last("_row", ignorenulls=True).over(Window.partitionBy("group").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = marks.unionByName(asked).withColumn("_row", last).filter("_kind = 1").select("group", F.col("_row.key").alias(key), (F.col("_at") - F.col("_row.first")).alias("_draw"))
    draws = found.groupBy(key).agg(F.first("group").alias("group"), F.collect_list("_draw").alias("_draws"))  # max_rows at most
    return _bounds(df.join(draws, key).withColumn("_draw", F.explode("_draws")), F.col("_draw")).drop("_draw", "_draws")


def next_k_split(df: DataFrame, col: str, k: int, pad: int, mask_token: int) -> DataFrame:
    """``col`` with its last k real tokens gone (the first such place holds ``mask_token``, the others ``pad``), ``label`` (those tokens), ``label_pos``. Fewer than k + 1 real tokens are an error."""
    n = F.size(F.filter(col, lambda x: x != pad))
    checked = F.when(n < k + 1, F.raise_error(F.lit(f"a sequence has fewer than {k + 1} tokens"))).otherwise(n)
    df = df.withColumn("_n", checked)
    at = F.col("_n") - k
    label = F.slice(col, at + 1, k)
    seq = F.concat(F.slice(col, F.lit(1), at), F.array(F.lit(mask_token).cast("long")), F.array_repeat(F.lit(pad).cast("long"), F.size(col) - at - 1))
    return df.select("*", label.alias("label"), at.alias("label_pos"), seq.alias("_seq")).drop(col, "_n").withColumnRenamed("_seq", col)


def token_labels(df: DataFrame, key: str, col: str, pad: int) -> DataFrame:
    return df.select(key, F.posexplode(col).alias("pos", "token")).filter(F.col("token") != pad)


def gather_locations(df: DataFrame, locs: DataFrame, key: str, col: str) -> DataFrame:
    """The values of ``col`` at (key, pos) of ``locs``; without ``pos`` whole rows."""
    joined = locs.join(df, key)
    return joined.withColumn("value", F.element_at(col, F.col("pos") + 1)) if "pos" in locs.columns else joined


def last_k_mask(length: int, last_index, k: int | None = None) -> Column:
    if k is not None and k < 1:
        raise ValueError("k must be 1 or more")
    last = F.col(last_index) if isinstance(last_index, str) else last_index
    first = F.lit(0) if k is None else F.greatest(last - k + 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i.between(first, last))


def offset_tokens(col: str, codebook_size: int, hierarchies: int, mask: str) -> Column:
    moved = F.transform(col, lambda x, i: x + (i % hierarchies) * codebook_size)
    return F.zip_with(moved, mask, lambda x, m: x * m)


def insert_separator(col: str, hierarchies: int, sep: int) -> Column:
    """``sep`` after each item's tokens; of a mask, pass its own last element by ``insert_mask``."""
    starts = F.sequence(F.lit(0), (F.size(col) / hierarchies).cast("int") - 1)
    return F.flatten(F.transform(starts, lambda i: F.concat(F.slice(col, i * hierarchies + 1, hierarchies), F.array(F.lit(sep).cast("long")))))


def insert_mask(mask: str, hierarchies: int) -> Column:
    starts = F.sequence(F.lit(0), (F.size(mask) / hierarchies).cast("int") - 1)
    return F.flatten(F.transform(starts, lambda i: F.concat(F.slice(mask, i * hierarchies + 1, hierarchies), F.slice(mask, (i + 1) * hierarchies, 1))))


def user_bin(col: str, n: int) -> Column:
    return F.pmod(F.col(col), F.lit(n))


def inference_rows(df: DataFrame, key: str, col: str, length: int, pad: int, oov: int | None = None) -> DataFrame:
    out = df.select(key, pad_or_trim(drop_token(col, oov), length, pad).alias(col))
    return out.withColumn("mask", attention_mask(col, pad))


def training_rows(df: DataFrame, key: str, col: str, step: int, length: int, k: int, pad: int, mask_token: int, max_rows: int, seed: int, oov: int | None = None, group_size: int | None = None) -> DataFrame:
    """Windows drawn by their numbers, at most ``max_rows`` per ``key``, or per ``group_size`` rows together, then cut out, trimmed, padded, split into input and label, and masked."""
    rows = df.select(key, col)
    spans = draw_windows(rows, key, col, step, max_rows, seed) if group_size is None else draw_group_windows(rows, key, col, step, group_size, max_rows, seed)
    group = [] if group_size is None else ["group"]
    rows = spans.select(*group, key, "start", "end", pad_or_trim(drop_token(window(col, step), oov), length, pad).alias(col))
    return next_k_split(rows, col, k, pad, mask_token).withColumn("mask", attention_mask(col, pad))
