"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are made in Arrow batches, then equal ones are one node each.
Bits that are correlated over the whole corpus share a partition; a dynamic
program gives each partition a threshold of its own (-1: not used), with the
thresholds plus one summing to tau + 1, so that two fingerprints at distance
tau or less are within the threshold in at least one partition. Each node is
indexed by its bits there and probes the keys within the threshold; what meets
is verified by the full distance.

At a similarity of 0.8 of five-word shingles 15 of 100 bits differ, and with so
wide a tau keys of bits alone bring together a fixed share of all pairs.
``link_similar`` therefore first asks for a shared shingle: the least of each
text's shingles in a few seeded orders, which texts without common shingles
never share. Groups too large to compare whole are cut by the least shingle of a
second order, and so on; what shares four and still is large, by the pigeonhole. The
bits, three more words of bits and the sizes decide on candidates. Each
block of them gives a forest of its links, never its pairs.

Bits and least shingles leave out some pairs that are similar enough.
``missed_links`` brings the rest: of the shingles of two such texts in one order
of all shingles, rare ones first, the first ones have one in common (prefix
filtering), so texts that share one there and that the bits have not brought
together meet as well. What then bounds their similarity (sizes, places in the
order, parities of the shingles) never drops a similar pair.

Both only make groups: ``verified`` compares the shingle sets of a group's texts,
again in blocks, and links those whose Jaccard similarity is high enough.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, settle
from .components import connected_components

BITS = 64
#: What writing and shuffling a probe costs against verifying a candidate.
PROBE_COST = 4.0
#: The same where candidates are verified in numpy blocks.
BLOCK_PROBE_COST = 500.0
#: Words of 64 bits beside the fingerprint, each from the shingles' hashes times an odd number (fixed values).
WIDE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Orders of the shingles; two texts are candidates if their least shingle is the same in one, or in up to ``DEPTH`` where many others share it. At a Jaccard of 0.8, 0.2 ** 8 of the pairs share none and 1 of 100 fewer than four.
ORDERS, DEPTH = 8, 4
#: Nodes of a block; groups whose largest piece is sent to every task.
BLOCK, MANY = 4096, 100_000
#: Blocks up to which what shares ``DEPTH`` hashes is compared whole: there the keys of bits at so wide a tau cost more than they save.
WHOLE = 16
#: Differing bits of ``WIDE`` at most for candidates; texts at a Jaccard of 0.8 differ in about 29, with a deviation of 5.
WIDE_TAU = 48
#: Texts from which a shingle comes last in the order of shingles, times that a task's chunk of shingles holds it to be counted, and shingles of a chunk. They decide on how many texts meet, not on which links are found.
HOT, TIMES, CHUNK = 64, 3, 1 << 21
#: Texts under one shingle up to which those without a partner are left out where they meet.
FEW = 1024
#: What rounding may take from a bound.
SLACK = 1e-6
#: Shingles of a block of texts that are compared as sets.
SET_BLOCK = 1 << 19


def _hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and splits at \x20 and \x09-\x0D
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([digest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    for k in range(0, n, 255):
        counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8: a bit is set if it is in over half the shingles' hashes; 0 without words."""
    return _majority(_hashes(text, shingle, seed))


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising."""
    return np.unique(_hashes(text, shingle, seed))


def least_hashes(hashes: np.ndarray) -> list[int]:
    """The least of a shingle set in each of ``ORDERS`` seeded orders, as signed numbers; nothing of an empty set."""
    if not len(hashes):
        return []
    x = hashes[None, :] + (np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(WIDE[0]))[:, None]
    for shift, odd in ((29, WIDE[1]), (32, WIDE[2]), (30, WIDE[0])):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(odd)
    return x.min(axis=1).view(np.int64).tolist()


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def parity_width(size: int) -> int:
    """Bits of the parities of a set: the least power of two, 64 or more, that is no less than its size."""
    return max(64, 1 << (size - 1).bit_length()) if size else 64


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes has each remainder. What is in one of two sets only changes one bit, so parities differ in no more bits than the sets in hashes."""
    width = parity_width(len(hashes))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, bytes]:
    """The fingerprint of a shingle set, and the same majority over ``WIDE`` other hashes of each shingle, as bytes."""
    others = []
    for odd in WIDE:
        x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(odd)
        others.append(_majority(x ^ (x >> np.uint64(32))))
    return _majority(hashes), np.array(others, np.int64).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, wide: bool = False) -> DataFrame:
    """(id, fp) per row; a null text is an empty one. With ``wide`` the bits are of the distinct shingles, and with them come the other words, the set's digest, its size, its least hashes and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or b"" for x in batch.column(1))
            if wide:
                sets = [shingle_set(x, shingle, seed) for x in texts]
                both = [wide_fingerprint(x) for x in sets]
                made = [pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.binary()), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(least_hashes, sets), pa.list_(pa.int64())), pa.array(map(parities, sets), pa.binary())]
            else:
                made = [pa.array([fingerprint(x, shingle, seed) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[id_col, "fp", "wide", "set", "size", "least", "parity"][: 1 + len(made)])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long" + ", wide binary, set binary, size long, least array<long>, parity binary" * wide)


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many of all fingerprints have both bits i and j set; on the diagonal, bit i. A table of 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            x = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    sums = nodes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for i, j, n in sums.collect():  # 64 x 64 rows at any size
        out[i, j] = n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into partitions of even width, each grown greedily from what correlates most with it."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def flips(width: int, threshold: int) -> int:
    """Keys that a node probes on average. Of two nodes only the one whose lowest differing bit is 0 probes, so half of all flips."""
    total, c = 1.0, 1.0
    for t in range(1, threshold + 1):
        c = c * (width - t + 1) / t
        total += c / 2
    return total


def allocate(counts: np.ndarray, n: int, tau: int, most_parts: int = 5, probe_cost: float = PROBE_COST) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of the least estimated cost.

    The candidates of a partition at threshold t are estimated from the whole
    corpus: its bits' shares give each bit's chance to differ, a convolution
    of these the chance of t differences or fewer. For each number of
    partitions a dynamic program over (partition, thresholds used) finds the
    least sum.
    """
    p = np.diag(counts) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = (np.inf, [], [])
    for parts in range(1, min(most_parts, tau + 1) + 1):
        groups = group_bits(counts, n, parts)
        costs = []
        for g in groups:
            dist = np.array([1.0])
            for b in g:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            costs.append([0.0] + [probe_cost * n * (1 + flips(len(g), t)) + n * n / 2 * dist[: t + 1].sum() for t in range(min(tau, 3) + 1)])
        table = {0: (0.0, [])}
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t1, more in enumerate(row):  # t1: the threshold plus one
                    if used + t1 <= tau + 1 and cost + more < step.get(used + t1, (np.inf,))[0]:
                        step[used + t1] = (cost + more, [*chosen, t1 - 1])
            table = step
        if tau + 1 in table and table[tau + 1][0] < best[0]:
            best = (table[tau + 1][0], groups, table[tau + 1][1])
    if not best[1]:
        raise ValueError(f"no thresholds of 3 or less in {most_parts} partitions cover a distance of {tau}")
    return best[1], best[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def link(nodes: DataFrame, tau: int = 4, block: int = BLOCK, plan: tuple | None = None) -> DataFrame:
    """Links (a, b) that connect just what links at distance ``tau`` or less connect, over distinct fingerprints ``fp``.

    Pairs come from a join of the indexed keys and the probes. What meets in a
    key that over ``block`` nodes are indexed under is compared in blocks
    instead, without its pairs: see ``link_groups``.
    """
    n = nodes.count()
    groups, thresholds = plan or allocate(bit_counts(nodes), n, tau)
    indexed, probes = None, None
    for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        at = nodes.select(F.lit(k).alias("part"), own.alias("key"), "fp")
        indexed = at if indexed is None else indexed.unionByName(at)
        # (what to flip, the lowest of these bits): the node probes if that bit is 0
        sets = [c for size in range(1, t + 1) for c in itertools.combinations(bits, size)]
        keys = F.array(F.struct(own.alias("key"), F.lit(True).alias("same")))
        if sets:
            listed = F.array(*[F.struct(F.lit(_mask(c)).alias("flip"), F.lit(_mask(c[:1])).alias("low")) for c in sets])
            open_ = F.filter(listed, lambda s: F.col("fp").bitwiseAND(s["low"]) == 0)
            keys = F.concat(keys, F.transform(open_, lambda s: F.struct(own.bitwiseXOR(s["flip"]).alias("key"), F.lit(False).alias("same"))))
        probe = nodes.select(F.lit(k).alias("part"), F.explode(keys).alias("x"), "fp").select("part", "x.key", "x.same", F.col("fp").alias("by"))
        probes = probe if probes is None else probes.unionByName(probe)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("by"))) <= tau
    once = ~F.col("same") | (F.col("by") < F.col("fp"))
    crowded = settle(indexed.groupBy("part", "key").count().filter(F.col("count") > block).select("part", "key"), "crowded")
    if crowded.isEmpty():
        met = indexed.join(probes.hint("shuffle_merge"), ["part", "key"]).filter(near & once)
        return met.select(F.col("fp").alias("a"), F.col("by").alias("b"))
    met = indexed.join(crowded, ["part", "key"], "left_anti").join(probes, ["part", "key"]).filter(near & once)
    # a node probes its own key as well, so the probes are all that meets in a key
    members = probes.join(crowded, ["part", "key"], "left_semi").select(F.xxhash64("part", "key").alias("grp"), F.col("by").alias("node"), F.col("by").alias("fp"))
    members = members.select("*", F.lit(1).alias("weight"), F.lit(bytes(8 * len(WIDE))).alias("wide"), F.lit(1).alias("size"))
    return met.select(F.col("fp").alias("a"), F.col("by").alias("b")).unionByName(link_groups(members, block, near_bits(tau, 0, 0.0)))


def _block_links(fp: np.ndarray, wide: np.ndarray, size: np.ndarray, tau: int, wide_tau: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that connect what is near in a block. A node is compared with those that nothing links yet."""
    free, todo = np.arange(len(fp)), []
    out_a, out_b = [], []
    while len(free):
        if not todo:
            todo.append(int(free[0]))
            free = free[1:]
        x = todo.pop()
        near = np.flatnonzero(np.bitwise_count(fp[free] ^ fp[x]) <= tau)
        if len(near):
            y = free[near]
            true = np.bitwise_count(wide[y] ^ wide[x]).sum(axis=1, dtype=np.int64) <= wide_tau
            true &= np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-9
            found = y[true].tolist()
            out_a += [x] * len(found)
            out_b += found
            todo += found
            free = np.delete(free, near[true])
    return out_a, out_b


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the first column, a number, from batches in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        key = table.column(0).to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def near_bits(tau: int, wide_tau: int, similarity: float):
    """What compares rows (key, node, fp, wide, size) of one key: links (a, b) of nodes whose bits are near and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, node, fp, size = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "fp", "size"))
            wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(-1, len(WIDE))
            bits, found = fp.view(np.uint64), []
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if b - a > 1:
                    x, y = _block_links(bits[a:b], wide[a:b], size[a:b], tau, wide_tau, similarity)
                    if x:
                        found.append((node[a:b][x], node[a:b][y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return lambda rows: rows.repartition("key").sortWithinPartitions("key").select("key", "node", "fp", "wide", "size").mapInArrow(run, "a long, b long")


def link_groups(members: DataFrame, room: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect just what pairs of one group connect. ``members`` is (grp, node, weight, ...); ``compare`` gives the links of rows with one ``key``.

    A group is dealt into blocks of about ``room`` by weight, and the first
    block meets every other. That leaves most groups in one piece; only what
    is not in a group's largest piece then meets all of its blocks. So a group
    of copies costs as its rows, and no link is left out: two members of one
    piece need no further one.
    """
    totals = settle(members.groupBy("grp").agg(F.greatest(F.ceil(F.sum("weight") / room), F.lit(1)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n"), "totals")
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = settle(members.join(totals, "grp").withColumn("home", home), "dealt")
    last = F.col("blocks") - 1
    at = F.when((F.col("home") == 0) & (last > 0), F.sequence(F.lit(1), last)).otherwise(F.array("home"))
    first = settle(compare(dealt.withColumn("at", F.explode(at)).withColumn("key", F.xxhash64("grp", "at"))), "first")
    spark, large = members.sparkSession, dealt.filter("blocks > 1")
    if large.isEmpty():
        discard(spark, totals, dealt)
        return first
    roots = connected_components(first)
    placed = settle(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    pieces = placed.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    rest = settle(placed.join(F.broadcast(pieces) if pieces.limit(MANY + 1).count() <= MANY else pieces, "grp").filter("root != most").drop("most"), "rest")
    pairs = [F.col("node").alias("a"), F.col("root").alias("b")]
    known = roots.select(*pairs).filter("a != b")
    if rest.isEmpty():
        discard(spark, totals, dealt, first, placed, rest)
        return known
    parts = settle(rest.groupBy("grp").agg(F.greatest(F.ceil(F.sum("weight") / room), F.lit(1)).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    some = rest.join(parts, "grp").withColumn("part", part).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    every = placed.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("at", F.col("home"))
    both = some.unionByName(every).withColumn("key", F.xxhash64("grp", "at", "part", F.lit(1)))
    further = settle(compare(both), "further")
    discard(spark, totals, dealt, first, placed, rest, parts)
    return known.unionByName(further)


def _in_groups(at: DataFrame) -> DataFrame:
    """The rows of ``at`` (grp, ...) whose group has another, with the group's size."""
    shared = settle(at.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = settle(at.join(shared, "grp"), "members")
    discard(at.sparkSession, shared)
    return members


def _keys(part: int, bits: list[int], threshold: int) -> Column:
    """The keys of a node in a partition of its group: its own, and those within the threshold that are its to probe."""
    own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
    mine = F.array(F.xxhash64("grp", F.lit(part), own))
    sets = [c for size in range(1, threshold + 1) for c in itertools.combinations(bits, size)]
    if not sets:
        return mine
    listed = F.array(*[F.struct(F.lit(_mask(c)).alias("flip"), F.lit(_mask(c[:1])).alias("low")) for c in sets])
    open_ = F.filter(listed, lambda s: F.col("fp").bitwiseAND(s["low"]) == 0)
    return F.concat(mine, F.transform(open_, lambda s: F.xxhash64("grp", F.lit(part), own.bitwiseXOR(s["flip"]))))


def candidate_groups(nodes: DataFrame, tau: int, block: int, depth: int = DEPTH) -> DataFrame:
    """(grp, node, fp, wide, size): the nodes (node, fp, wide, size, least) once per group that is compared whole.

    A group shares a ``least`` hash. One that does not fit a block is split
    by the further orders: its nodes share two hashes there, then three, up to
    ``depth``. A text that a hot shingle brings together with many others meets
    only those that it has more in common with, and a pair that shares m
    orders is lost only where each of its groups of fewer is large and m is
    less than their depth. What is still large at the last depth (over
    ``WHOLE`` blocks, where that is more than 1) is cut by the generalised pigeonhole: nodes meet under their own bits of a partition and
    under those within the partition's threshold. Similar pairs that meet in no
    group are those of ``missed_links``.
    """
    data = ["node", "fp", "wide", "size"]
    kept = None
    at = nodes.select(F.posexplode("least").alias("last", "grp"), *data, "least")
    for level in range(depth):
        members = _in_groups(at)
        room = block * (WHOLE if depth > 1 and level + 1 == depth else 1)
        small, large = members.filter(F.col("n") <= room).select("grp", *data), members.filter(F.col("n") > room)
        kept = small if kept is None else kept.unionByName(small)
        if large.isEmpty():
            return kept
        if level + 1 < depth:
            further = F.expr("transform(filter(sequence(0, size(least) - 1), j -> j > last), j -> named_struct('grp', xxhash64(grp, j, least[j]), 'last', j))")
            at = large.select(F.explode(further).alias("x"), *data, "least").select("x.grp", "x.last", *data, "least")
    n = large.agg(F.max("n")).first()[0]
    groups, thresholds = allocate(bit_counts(large.dropDuplicates(["node"])), n, tau, most_parts=8, probe_cost=BLOCK_PROBE_COST)
    keys = F.concat(*[_keys(k, bits, t) for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0])
    return kept.unionByName(large.withColumn("key", F.explode(keys)).select(F.col("key").alias("grp"), *data))


def link_similar(nodes: DataFrame, tau: int, wide_tau: int, similarity: float, block: int | None = None, depth: int = 1) -> DataFrame:
    """Links (a, b) of candidates among ``nodes`` (node, fp, wide, size, least): those of one of the ``candidate_groups`` that lie within ``tau`` and ``wide_tau`` bits and whose sizes allow ``similarity``. At a ``depth`` of 1 one shared hash is enough in any group."""
    block = block or BLOCK
    groups = candidate_groups(nodes, tau, block, depth)
    return link_groups(groups.withColumn("weight", F.lit(1)), block, near_bits(tau, wide_tau, similarity))


def hot_shingles(docs: DataFrame, text_col: str, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, rising, and how often they were counted: the ``MANY`` most frequent of ``HOT`` texts or more."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= TIMES
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], CHUNK
        for batch in batches:
            for x in batch.column(0):
                held.append(shingle_set(x.as_py() or b"", shingle, seed))
                room -= len(held[-1])
                if room <= 0:
                    yield counted(held)
                    held, room = [], CHUNK
        if held:
            yield counted(held)

    counts = docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, "hash long, n long")
    most = counts.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT).orderBy(F.desc("n"), "hash").limit(MANY)
    found = np.array([tuple(r) for r in most.collect()], np.int64).reshape(-1, 2)  # at most MANY rows at any size
    hashes = found[:, 0].astype(np.int64).view(np.uint64) if len(found) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found[order, 1]


def prefix(hashes: np.ndarray, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's hashes, hot ones last and these by rising count: as many as leave fewer than a similar set must share."""
    size = len(hashes)
    most = min(size, size - int(np.ceil(similarity * size - SLACK)) + 1)
    values, counts = hot
    if not len(values):
        return hashes[:most]
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    late = values[at] == hashes
    first = hashes[~late][:most]
    if len(first) == most:
        return first
    rest = hashes[late]
    return np.concatenate([first, rest[np.lexsort((rest, counts[at[late]]))][: most - len(first)]])


def _allowed(size: np.ndarray, pos: np.ndarray, size2: np.ndarray, pos2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share the hashes at these places of their orders, and none before, can be similar enough."""
    most = np.minimum(size - pos, size2 - pos2)
    near = np.minimum(size, size2) >= similarity * np.maximum(size, size2) - SLACK
    return near & (most >= similarity / (1 + similarity) * (size + size2) - SLACK)


def _partners(grp: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Positions of the rows, in order of ``grp`` and ``node``, that have a partner in their group; of groups over ``FEW`` all."""
    kept = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (node[1:] != node[:-1])]))
    begins = np.flatnonzero(np.concatenate([[True], grp[kept][1:] != grp[kept][:-1]]))
    n = np.diff([*begins, len(kept)])
    two = kept[begins[n == 2]], kept[begins[n == 2] + 1]
    good = _allowed(size[two[0]], pos[two[0]], size[two[1]], pos[two[1]], similarity)
    out = [two[0][good], two[1][good]]
    for b, m in zip(begins[n > 2].tolist(), n[n > 2].tolist(), strict=True):
        k = kept[b : b + m]
        if m <= FEW:
            both = _allowed(size[k][:, None], pos[k][:, None], size[k], pos[k], similarity)
            np.fill_diagonal(both, False)
            k = k[both.any(axis=1)]
        out.append(k)
    return np.concatenate(out)


def prefix_groups(docs: DataFrame, text_col: str, shingle: int, seed: int, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(grp, node) of the shingles, as ``grp``, that the prefixes of two or more sets hold which can be similar; two sets with the similarity are in one group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, names, found, sizes = set(), [], [], []
            for x in batch.column(0):
                hashes = shingle_set(x.as_py() or b"", shingle, seed)
                name = xxhash.xxh64_intdigest(_digest(hashes), 42)  # as Spark's xxhash64 of the digest
                if len(hashes) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    found.append(prefix(hashes, similarity, hot))
                    sizes.append(len(hashes))
                if names and (len(names) == 1000 or sizes[-1] > CHUNK):
                    yield table(names, found, sizes)
                    names, found, sizes = [], [], []
            if names:
                yield table(names, found, sizes)

    def table(names: list[int], found: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        n = np.array([len(x) for x in found])
        pos = np.concatenate([np.arange(k) for k in n.tolist()])
        columns = [np.concatenate(found).view(np.int64), np.repeat(np.array(names, np.uint64).view(np.int64), n), np.repeat(np.array(sizes, np.int64), n), pos.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["grp", "node", "size", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            columns = [t.column(c).to_numpy() for c in ("grp", "node", "size", "pos")]
            k = _partners(*columns, similarity)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(columns[0][k]), pa.array(columns[1][k])], names=["grp", "node"])

    texts = docs.select(F.col(text_col).cast("binary").alias("_text"))
    dealt = texts.mapInArrow(rows, "grp long, node long, size long, pos long").repartition("grp").sortWithinPartitions("grp", "node")
    return dealt.mapInArrow(run, "grp long, node long")


def _parity_links(bits: np.ndarray, size: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that connect what sizes and parities allow to be similar. A node is compared with those that nothing links yet."""
    free, todo = np.arange(len(size)), []
    out_a, out_b = [], []
    while len(free):
        if not todo:
            todo.append(int(free[0]))
            free = free[1:]
        x = todo.pop()
        allowed = np.minimum(size[free], size[x]) >= similarity * np.maximum(size[free], size[x]) - SLACK
        near = np.flatnonzero(allowed)
        differ = np.bitwise_count(bits[free[near]] ^ bits[x]).sum(axis=1, dtype=np.int64)
        near = near[differ <= (1 - similarity) / (1 + similarity) * (size[free[near]] + size[x]) + SLACK]
        if len(near):
            found = free[near].tolist()
            out_a += [x] * len(found)
            out_b += found
            todo += found
            free = np.delete(free, near)
    return out_a, out_b


def _folded(parity: bytes, width: int) -> bytes:
    """Parities of ``width`` bits from those of as many or more."""
    if len(parity) * 8 == width:
        return parity
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint8).reshape(-1, width // 8), axis=0).tobytes()


def near_parities(similarity: float):
    """What compares rows (key, node, parity, width, size) of one key and width: links (a, b) of nodes whose parities and sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, node, width, size = (t.column(c).to_numpy() for c in ("key", "node", "width", "size"))
            parity, found = t.column("parity").to_pylist(), []
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (width[1:] != width[:-1])) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if b - a > 1:
                    w = int(width[a])
                    bits = np.frombuffer(b"".join(_folded(x, w) for x in parity[a:b]), np.uint64).reshape(b - a, -1)
                    x, y = _parity_links(bits, size[a:b], similarity)
                    if x:
                        found.append((node[a:b][x], node[a:b][y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return lambda rows: rows.repartition("key").sortWithinPartitions("key", "width").select("key", "node", "parity", "width", "size").mapInArrow(run, "a long, b long")


def missed_links(docs: DataFrame, text_col: str, nodes: DataFrame, roots: DataFrame, shingle: int, seed: int, similarity: float, block: int | None = None) -> DataFrame:
    """Links (a, b) that with ``roots`` (node, root) connect all pairs of ``nodes`` (node, size, parity) with a Jaccard similarity of ``similarity`` or more, and some others.

    A pair shares a shingle of its prefixes. Shingles whose texts ``roots``
    has together already are left out. Nodes meet under a shingle by the width
    of their parities, and by each smaller one that a similar set can have. Groups that are too large for a block are dealt into
    some, see ``link_groups``; none is cut.
    """
    met = prefix_groups(docs, text_col, shingle, seed, similarity, hot_shingles(docs, text_col, shingle, seed))
    known = nodes.select("node", "size", "parity").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = settle(known, "known")
    at = settle(met.join(known.select("node", "root"), "node"), "met")
    apart = at.groupBy("grp").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("grp")
    width = F.octet_length("parity") * 8
    halves = F.array(*[F.shiftright(width, k) for k in range(int(np.ceil(-np.log2(similarity))) + 1)])
    widths = F.filter(halves, lambda w: (w == width) | (w >= 64) & (w >= similarity * F.col("size") - SLACK))
    members = at.select("grp", "node").join(apart, "grp", "left_semi").join(known.drop("root"), "node").withColumn("width", F.explode(widths))
    members = members.withColumn("grp", F.xxhash64("grp", "width")).withColumn("weight", F.greatest(F.lit(1), (F.col("width") / 1024).cast("int")))
    links = settle(link_groups(settle(members, "members"), block or BLOCK, near_parities(similarity)), "missed")
    discard(docs.sparkSession, known, at)
    return links


def _set_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect just what pairs with a Jaccard similarity of ``similarity`` or more connect. A set is compared with those that nothing links yet."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    ends = np.cumsum(sizes)
    mine = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    free = np.arange(len(sets))  # what no set has linked yet, and their shingles
    held, who = flat, np.repeat(free, sizes)
    marked = np.zeros(len(values), bool)
    out_a, out_b, todo = [], [], []
    gone = np.zeros(len(sets), bool)
    while True:
        if not todo:
            free = free[~gone[free]]
            if not len(free):
                return out_a, out_b
            todo.append(int(free[0]))
            gone[free[0]] = True
        x = todo.pop()
        stay = ~gone[who]
        if stay.sum() * 2 < len(stay):
            held, who = held[stay], who[stay]
        marked[mine[x]] = True
        common = np.bincount(who[marked[held]], minlength=len(sets))
        marked[mine[x]] = False
        either = sizes + sizes[x] - common
        near = np.flatnonzero(~gone & ((common >= similarity * either - 1e-9) | (either == 0)))
        gone[near] = True
        out_a += [x] * len(near)
        out_b += near.tolist()
        todo += near.tolist()


def verified(members: DataFrame, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """Links (a, b) between the ``set`` of ``members`` (root, set, size, hashes: the shingles' hashes as bytes) that connect just what pairs of one root with a Jaccard similarity of ``similarity`` or more connect, in blocks of about ``block`` shingles."""

    def run(group: pa.Table) -> pa.Table:
        names = group.column("node").to_pylist()
        a, b = _set_links([np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()], similarity)
        return pa.table({"a": pa.array([names[k] for k in a], pa.binary()), "b": pa.array([names[k] for k in b], pa.binary())})

    def compare(rows: DataFrame) -> DataFrame:
        return rows.select("key", "node", "hashes").groupBy("key").applyInArrow(run, "a binary, b binary")

    return link_groups(members.select(F.col("root").alias("grp"), F.col("set").alias("node"), F.col("size").alias("weight"), "hashes"), block, compare)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, tau: int, seed: int, similarity: float) -> DataFrame:
    """``near_dedup`` with a similarity. Nodes are distinct shingle sets."""
    rows = settle(fingerprints(docs, id_col, text_col, shingle, seed, True).withColumnRenamed(id_col, "_id"), "fingerprints")
    first = [F.first(c).alias(c) for c in ("fp", "wide", "size", "least", "parity")]
    nodes = settle(rows.groupBy("set").agg(F.min("_id").alias("_least"), *first).withColumn("node", F.xxhash64("set")), "nodes")
    links = settle(link_similar(nodes.drop("set", "_least", "parity"), tau, max(WIDE_TAU, int((1 - similarity) * BITS * len(WIDE) + 1e-9)), similarity, depth=DEPTH), "similar")
    links = links.unionByName(missed_links(docs, text_col, nodes, connected_components(links), shingle, seed, similarity))
    chosen = settle(nodes.join(connected_components(links), "node").select("root", "set", "size", "_least"), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py() or b"", shingle, seed) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set", "hashes"])

    wanted = chosen.select("_least").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_least")), "left_semi").select("_text")
    hashes = texts.mapInArrow(sets, "set binary, hashes binary").dropDuplicates(["set"])
    members = settle(chosen.select("root", "set", "size").join(hashes, "set"), "members")
    parts = connected_components(verified(members, similarity)).withColumnsRenamed({"node": "set", "root": "part"})
    joined = settle(nodes.join(parts, "set", "left").select("set", "_least", F.coalesce("part", "set").alias("part")), "rooted")
    discard(docs.sparkSession, nodes, chosen, members)
    named = joined.join(joined.groupBy("part").agg(F.min("_least").alias("component_id")), "part").select("set", "component_id")
    return rows.select("_id", "fp", "set").join(named, "set").select(F.col("_id").alias(id_col), "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4, seed: int = 42, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """One row per input row: id, ``fp`` (long), ``component_id`` (the smallest id reachable over links, itself included).

    Texts without words (null and empty ones among them) have fingerprint 0
    and are linked like any other. Rows may repeat; a null id never becomes a
    component_id unless nothing else is reachable. Other columns are ignored.

    With a ``similarity``, links are pairs whose sets of shingles have at
    least that Jaccard similarity, all of them; the bits, within ``tau``, find
    most candidates, shared prefixes the others (``missed_links``), and ``fp`` is
    that of the distinct shingles.
    """
    if similarity is not None:
        return _similar(docs, id_col, text_col, shingle, tau, seed, similarity)
    rows = settle(fingerprints(docs, id_col, text_col, shingle, seed).withColumnRenamed(id_col, "_id"), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "nodes")
    links = link(nodes.select("fp"), tau, block)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    joined = settle(nodes.join(roots, "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def query(spark, sf_dir):
    from ._shared import table

    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
