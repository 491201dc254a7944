"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are a group and share a shard. Groups sorted by size
enter the bin with the least remaining capacity that holds them, found in a
balanced tree of the open bins. The driver packs size classes, not groups:
how many groups of each size go to which bin is all that best fit decides,
and there are a bounded number of sizes (exact to ``EXACT``, rounded up to as
many steps between powers of two beyond). Which group it is comes from its
rank within its class, and ranks, joins and slots are Spark's, in shares of
``SHARE`` rows at any size of the table.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle, table

SHARDS = 24
#: Sizes up to this are classes of their own; beyond, a class is less than 1/2048 wide.
EXACT = 4096
#: Rows of a share within which ranks are counted, about.
SHARE = 100_000
#: Groups with more than one in so many of the rows are joined by broadcast: there are fewer than this.
HOT = 4096


class Tree:
    """Open bins by (remaining capacity, bin): a treap, balanced by the digest of what it holds."""

    def __init__(self):
        self.root = None

    def _split(self, node, key):
        """The nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return (low[0], low[1], low[2], self._join(low[3], high))
        return (high[0], high[1], self._join(low, high[2]), high[3])

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, (key, zlib.crc32(f"{remaining}:{bin_}".encode()), None, None)), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``, the first of equal ones."""
        low, high = self._split(self.root, (size, -1))
        found, node = None, high
        while node is not None:
            found, node = node[0], node[2]
        self.root = self._join(low, self._split(high, (found[0], found[1] + 1))[1]) if found else self._join(low, high)
        return found


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[dict[int, int]] | None:
    """Groups of each size per bin, for (size, count) of falling size; None if more than ``most`` bins would open. A size over the capacity is an error.

    Equal groups follow each other into one bin until it is too full for the
    next: having taken one, it is tighter than before and stays the tightest.
    """
    tree, bins = Tree(), []
    for size, count in classes:
        if size > capacity:
            raise ValueError(f"a group of {size} in shards of {capacity}")
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if len(bins) == most:
                    return None
                found = (capacity, len(bins))
                bins.append({})
            remaining, at = found
            n = min(count, remaining // size)
            bins[at][size] = n
            tree.add(remaining - n * size, at)
            count -= n
    return bins


def even_out(bins: list[dict[int, int]]) -> list[dict[int, int]]:
    """Move groups from the fullest bin to the emptiest while that brings the two closer.

    Best fit leaves what room there is in few bins. Each move takes the
    largest groups that fit in the gap and as many as halve it, so the sum of
    squares falls and the fullest bin gives nothing in the end only if its
    smallest group is as large as the gap.
    """
    load = [sum(s * n for s, n in b.items()) for b in bins]
    order = sorted((x, k) for k, x in enumerate(load))
    sizes = [sorted(b) for b in bins]
    while len(order) > 1:
        (low, to), (high, of) = order[0], order[-1]
        at = bisect_left(sizes[of], (high - low) // 2 + 1)
        # the largest of at most half the gap; else the smallest, if it is less than the gap
        size = sizes[of][at - 1] if at else sizes[of][0] if sizes[of] else high - low
        if size >= high - low:
            break
        n = min(bins[of][size], max(1, (high - low) // 2 // size))
        for b, moved in ((of, -n), (to, n)):
            if size not in bins[b]:
                insort(sizes[b], size)
            bins[b][size] = bins[b].get(size, 0) + moved
            if not bins[b][size]:
                del bins[b][size]
                sizes[b].remove(size)
        del order[-1], order[0]
        insort(order, (low + n * size, to))
        insort(order, (high - n * size, of))
    return bins


def plan(counts: dict[int, int], capacity: int | None = None, shards: int | None = None) -> list[dict[int, int]]:
    """Groups of each size per shard.

    With a ``capacity``, as few shards as best fit needs. With ``shards``, the
    least capacity for which best fit needs no more, then evened out; groups
    larger than an even share have shards of their own.
    """
    classes = sorted(((s, n) for s, n in counts.items() if n), reverse=True)
    if capacity is not None:
        return best_fit(classes, capacity)
    own, total = [], sum(s * n for s, n in classes)
    while classes and shards - len(own) > 1 and classes[0][0] * (shards - len(own)) > total:
        size, n = classes.pop(0)
        own.append({size: 1})
        total -= size
        if n > 1:
            classes.insert(0, (size, n - 1))
    left = shards - len(own)
    if not classes:
        return own + [{} for _ in range(left)]
    low = max(classes[0][0], -(-total // left))
    high, best = low + classes[0][0], None  # a group that no bin of such room takes would make the total larger than it is
    best = best_fit(classes, high, left)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(classes, middle, left)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return own + even_out(best + [{} for _ in range(left - len(best))])


def size_class(size: Column) -> Column:
    """The size, rounded up to 11 or 12 significant bits beyond ``EXACT``."""
    step = F.expr("shiftleft(1L, cast(floor(log2(cast(greatest(_size, 1) as double))) as int) - 11)")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step).cast("long") * step)


def shard_groups(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: a shard from 0 by best-fit-decreasing, a gapless place from 0 within it.

    Either ``shards`` or a ``capacity`` in bytes is given; a group counts up
    to 1/2048 more than its size, and one over the capacity is an error. A row's size is its
    text's UTF-8 bytes and ``overhead``. Rows of equal texts share a shard,
    null and empty texts being equal. Of classes, groups with smaller digests
    go to lower shards; slots follow the digest of id and text. Null ids and
    repeated rows are rows like any other; texts of any length are read once;
    other columns are ignored; an empty table gives an empty one. Texts whose
    64-bit digests are equal are one group, which breaks no rule.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_g"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = settle(rows, "sized")
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    groups = settle(groups.withColumn("_class", size_class(F.col("_size"))), "groups")
    counts = {r["_class"]: r["n"] for r in groups.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # a row per size class: 4096 and 2048 for each doubling
    bins = plan(counts, capacity, shards if capacity is None else None)
    spans: dict = {}
    for shard, b in enumerate(bins):
        for size, n in b.items():
            have = spans.setdefault(size, [])
            have.append((have[-1][0] + n if have else n, shard))
    known = docs.sparkSession.createDataFrame([(size, -(-counts[size] // SHARE), have) for size, have in spans.items()], "_class long, _shares long, _spans array<struct<upto:long,shard:int>>")
    placed = groups.join(F.broadcast(known), "_class").withColumn("_share", F.pmod(F.xxhash64("_g"), F.col("_shares")))
    at = _rank(placed, ["_class", "_share"], "_g")
    shard = F.filter("_spans", lambda s: s["upto"] > F.col("_at"))[0]["shard"]
    placed = settle(at.select("_g", "_n", shard.alias("shard")), "placed")
    many = rows.count()
    least = max(2, -(-many // HOT))
    hot = F.broadcast(placed.filter(F.col("_n") >= least).select("_g", "shard"))  # at most HOT rows
    cool = placed.filter(F.col("_n") < least).select("_g", "shard")
    found = rows.join(hot, "_g").unionByName(rows.join(hot, "_g", "left_anti").join(cool, "_g"))
    found = found.withColumn("_d", F.xxhash64("_id", "_g")).withColumn("_share", F.pmod("_d", F.lit(max(1, math.ceil(many / SHARE)))))
    out = _rank(settle(found, "sharded"), ["shard", "_share"], "_d", "_id", "_g")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", F.col("_at").alias("slot"))


def _rank(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``rows`` with ``_at``, the rank from 0 within the first of ``keys``: that within both keys, and the rows of the shares before."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(sizes.select(*keys, before.alias("_before")), keys).withColumn("_at", (F.col("_rank") - 1 + F.col("_before")).cast("long"))


def query(spark, sf_dir):
    found = shard_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
