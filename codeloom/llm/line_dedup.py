"""Line dedup by pairwise alignment.

Documents that share rare lines are found through the lines' hashes: in each
stretch of neighbouring shared lines of a document, the line that the fewest
documents hold leads it to that line's first holder. The two are aligned by
patience diff around the line, and the aligned common blocks go from the later
one. A line's first document keeps it, so nothing disappears from the corpus.

An alignment is one to one and rising, and with one holder of a stretch. What
it leaves (a repeated or moved run of lines, or one that another document
holds) leads, in a second round, to the first holder of that run: each smallest
run of lines that could be deleted and still is there, by the run's hash. Such
a pair is aligned by patience diff around the run. Nothing goes but by an
alignment; and as the run at which a pair is aligned begins both sides there,
it lies in one of the aligned blocks, so that after the second round no run
with an earlier holder is left. So what goes in the end is every line that lies in a common
block with any earlier document, however many hold it, and each document meets
at most one holder per stretch or run; no pairs of a group come out. Of both
documents only the stretch around the places at which they meet is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import discard, others, settle

RANGES = "array<struct<start:int,end:int>>"
#: Lines to either side that are aligned at first.
REACH = 64
KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both: equal ends first, then lines unique on both sides by their longest rising run, and so on between them; where none are, a longest common subsequence."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at_a, at_b = _unique(a, a0, a1), _unique(b, b0, b1)
        rising = _longest([(at_a[x], j) for x, j in sorted(at_b.items(), key=lambda y: y[1]) if x in at_a])
        if rising:
            for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *rising], [*rising, (a1, b1)], strict=True):
                todo.append((i + 1, i2, j + 1, j2))
            out += rising
        else:
            out += _lcs(a, a0, a1, b, b0, b1)
    return sorted(out)


def _lcs(a: list, a0: int, a1: int, b: list, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two stretches, a row of bits per line."""
    both = set(a[a0:a1]) & set(b[b0:b1])
    i_s, j_s = [i for i in range(a0, a1) if a[i] in both], [j for j in range(b0, b1) if b[j] in both]
    at: dict = {}
    for k, j in enumerate(j_s):
        at[b[j]] = at.get(b[j], 0) | 1 << k
    full = (1 << len(j_s)) - 1
    rows = [full]
    for i in i_s:
        v = rows[-1]
        u = v & at[a[i]]
        rows.append(((v + u) | (v - u)) & full)
    out, row, col = [], len(i_s), len(j_s)
    while row and col:
        if rows[row] >> (col - 1) & 1:
            col -= 1
        elif rows[row - 1] >> (col - 1) & 1:
            row, col = row - 1, col - 1
            out.append((i_s[row], j_s[col]))
        else:
            row -= 1
    return out


def _unique(lines: list, begin: int, end: int) -> dict:
    seen: dict = {}
    for k in range(begin, end):
        seen[lines[k]] = -1 if lines[k] in seen else k
    return {x: k for x, k in seen.items() if k >= 0}


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in the first number, by patience sorting."""
    import bisect

    tops, piles, back = [], [], {}
    for k, (i, _) in enumerate(pairs):
        p = bisect.bisect_left(tops, i)
        back[k] = piles[p - 1] if p else None
        if p == len(tops):
            tops.append(i)
            piles.append(k)
        else:
            tops[p], piles[p] = i, k
    out, k = [], piles[-1] if piles else None
    while k is not None:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def blocks(matches: list[tuple[int, int]], early: list[tuple], late: list[tuple], least_words: int) -> list[tuple[int, int]]:
    """Line ranges of ``late`` to delete. Both are (line number, hash, words) of shared lines; a block is a run of matches that are neighbours on both sides, ``least_words`` words or more in all."""
    out, run, words = [], None, 0
    for i, j in matches:
        p, q = early[i][0], late[j][0]
        if run and p == run[2] + 1 and q == run[1] + 1:
            run, words = (run[0], q, p), words + late[j][2]
        else:
            if run and words >= least_words:
                out.append((run[0], run[1]))
            run, words = (q, q, p), late[j][2]
    if run and words >= least_words:
        out.append((run[0], run[1]))
    return out


def aligned_at(early: list[tuple], late: list[tuple], i: int, j: int, least_words: int, reach: int = REACH) -> list[tuple[int, int]]:
    """Line ranges of ``late`` to delete, by patience diff of what lies before ``early[i]`` and ``late[j]`` and of what begins there.

    At most ``reach`` lines to either side are aligned, and more of them as
    long as the block at the two lines goes on to the end of these.
    """
    lines = lambda rows, a, b: [x[1] for x in rows[a:b]]
    reach = max(reach, least_words)  # so that a block that goes on beyond the lines is one
    while True:
        a, b, c, d = max(0, i - reach), max(0, j - reach), min(len(early), i + reach), min(len(late), j + reach)
        matches = [(a + x, b + y) for x, y in patience(lines(early, a, i), lines(late, b, j))] + [(i + x, j + y) for x, y in patience(lines(early, i, c), lines(late, j, d))]
        found = blocks(matches, early, late, least_words)
        own = next((r for r in found if r[0] <= late[j][0] <= r[1]), None)
        cut_left = own and a and b and own[0] == late[b][0]
        cut_right = own and c < len(early) and d < len(late) and own[1] == late[d - 1][0]
        if not (cut_left or cut_right):
            return found
        reach *= 4


def anchored_blocks(early: list[tuple], late: list[tuple], anchors: list[tuple[int, int, int]], least_words: int) -> list[tuple[int, int]]:
    """Line ranges of ``late`` to delete by alignments at (line of late, last line of the run there, line of early), one after the other where the run still stands."""
    at_early, at_late = {x[0]: k for k, x in enumerate(early)}, {x[0]: k for k, x in enumerate(late)}
    out: list = []
    gone: set[int] = set()
    for pos, end, f_pos in sorted(anchors):
        if all(p in gone for p in range(pos, end + 1)):
            continue
        for r in aligned_at(early, late, at_early[f_pos], at_late[pos], least_words):
            out.append(r)
            gone.update(range(r[0], r[1] + 1))
    return out


def runs_around(seq: list[tuple], k: int, least_words: int) -> list[tuple[int, int]]:
    """The smallest runs (first, last) of neighbouring lines around ``seq[k]`` that have ``least_words``. A block that takes the line away holds one of them."""
    out, start, before = [], k, 0
    while True:
        words, end = before + seq[k][2], k
        while words < least_words and end + 1 < len(seq) and seq[end + 1][0] == seq[end][0] + 1:
            end += 1
            words += seq[end][2]
        if words >= least_words and (start == k or words - seq[start][2] < least_words):
            out.append((start, end))
        if before + seq[k][2] >= least_words or not start or seq[start - 1][0] != seq[start][0] - 1:
            return out
        start -= 1
        before += seq[start][2]


def run_hash(seq: list[tuple], run: tuple[int, int]) -> bytes:
    if run[0] == run[1]:
        return seq[run[0]][1]
    return hashlib.blake2b(b"".join(x[1] for x in seq[run[0] : run[1] + 1]), digest_size=16).digest()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest runs of lines that the ranges hold."""
    out: list = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _stretches(seq: list[tuple]) -> tuple[list[int], list[int]]:
    """Of each line the first and the last line of its stretch of neighbouring lines."""
    begins, stops = [], [0] * len(seq)
    for k, x in enumerate(seq):
        begins.append(begins[-1] if k and seq[k - 1][0] == x[0] - 1 else x[0])
    for k in range(len(seq) - 1, -1, -1):
        stops[k] = stops[k + 1] if k + 1 < len(seq) and seq[k + 1][0] == seq[k][0] + 1 else seq[k][0]
    return begins, stops


def _tuples(seq: pa.Scalar) -> list[tuple]:
    return [(x["pos"], x["line"], x["words"]) for x in seq.as_py()]


def _ranges(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in found], KIND)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """The rows of ``docs`` with deleted lines gone from the text, and ``_deleted``, the deleted line ranges (start, end, both included).

    A line goes if it lies in a block of neighbouring lines, ``least_words``
    words or more in all, that a document with a smaller id has too. Lines are
    cut at newlines and compared whole; blank ones match nothing and end a
    block. A text all of whose lines go is empty. Null and empty texts and
    rows with a null id stay as they are; rows that repeat an id are cleaned
    each for itself, against smaller ids only. Texts of any length are read
    whole. Other columns pass through, but for one named ``_deleted``, which
    is replaced. An empty table gives an empty one.
    """
    key = ["_id", "_h"]
    text = F.col(text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text")).filter("_id IS NOT NULL AND _text IS NOT NULL")
    lines = rows.select(*key, F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line")).filter("trim(line) != ''")
    words = F.size(F.split(F.trim("line"), r"\s+"))
    lines = settle(lines.select(*key, "pos", F.unhex(F.md5("line")).alias("line"), words.alias("words")), "lines")
    me = F.struct("_id", "_h", "pos")
    holders = lines.groupBy("line").agg(F.min(me).alias("first"), F.max("_id").alias("last"), F.count("*").alias("held")).filter("first._id < last").drop("last")
    holders = settle(holders, "holders")  # so that the join's sides are exchanges, which Spark can split
    shared = settle(lines.join(holders, "line").dropDuplicates([*key, "pos"]), "shared")
    sequence = F.array_sort(F.collect_list(F.struct("pos", "line", "words"))).alias("seq")
    sequences = settle(shared.groupBy(*key).agg(sequence), "sequences")

    # a stretch: lines at neighbouring positions; its rarest line with an earlier holder leads to that one
    stretch = (F.col("pos") - F.row_number().over(W.partitionBy(*key).orderBy("pos"))).alias("stretch")
    lead = F.min(F.when(F.col("first._id") < F.col("_id"), F.struct("held", "first", "pos"))).alias("lead")
    leads = shared.select(*key, "pos", "first", "held", stretch).groupBy(*key, "stretch").agg(lead, F.min("pos").alias("begin"), F.max("pos").alias("stop")).filter("lead IS NOT NULL")
    leads = leads.select(*key, "lead.first", F.col("lead.pos").alias("pos"), F.col("lead.pos").alias("end"), "begin", "stop")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                out.append(anchored_blocks(_tuples(a), _tuples(b), [(y["pos"], y["end"], y["f_pos"]) for y in x.as_py()], least_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ranges(out)], names=["_id", "_h", "ranges"])

    found_type = f"_id {id_type}, _h long, ranges {RANGES}"
    early = sequences.withColumnsRenamed({"_id": "f_id", "_h": "f_h", "seq": "early"})

    def round_of(anchors: DataFrame) -> DataFrame:
        """(_id, _h, ranges) by alignment with first holders, at places (pos to end) of stretches (begin to stop) of the later document."""
        pairs = anchors.groupBy(*key, F.col("first._id").alias("f_id"), F.col("first._h").alias("f_h")).agg(
            F.collect_set(F.struct("pos", "end", F.col("first.pos").alias("f_pos"))).alias("anchors"),
            F.min("begin").alias("begin"), F.max("stop").alias("stop"),
            F.min(F.col("first.pos") - F.col("pos") + F.col("begin")).alias("f_begin"), F.max(F.col("first.pos") - F.col("pos") + F.col("stop")).alias("f_stop"),
        )
        within = lambda seq, a, b: F.filter(seq, lambda x: x["pos"].between(F.col(a), F.col(b)))
        both = pairs.join(sequences, key).withColumn("seq", within("seq", "begin", "stop")).join(early, ["f_id", "f_h"])
        rows = both.select(*key, within("early", "f_begin", "f_stop").alias("early"), "seq", "anchors").mapInArrow(align, found_type).filter("size(ranges) > 0")
        return rows.groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    found = settle(round_of(leads), "aligned")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of each sequence, the stretches they lie in, and whether they are around a line that nothing deletes yet."""
        for batch in batches:
            who, keys, left, spans = [], [], [], []
            for n, (seq, gone) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                seq = _tuples(seq)
                out = {p for r in gone.as_py() or [] for p in range(r["start"], r["end"] + 1)}
                begins, stops = _stretches(seq)
                said: dict[tuple[int, int], bool] = {}
                for k, x in enumerate(seq):
                    for run in runs_around(seq, k, least_words):
                        said[run] = said.get(run, False) or x[0] not in out
                who += [n] * len(said)
                keys += [run_hash(seq, run) for run in said]
                left += said.values()
                spans += [(seq[a][0], seq[b][0], begins[a], stops[a]) for a, b in said]
            who = pa.array(who, pa.int32())
            columns = [pa.array(x, pa.int32()) for x in (zip(*spans, strict=True) if spans else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(keys, pa.binary()), pa.array(left, pa.bool_()), *columns], names=["_id", "_h", "run", "open", "pos", "end", "begin", "stop"])

    held = sequences.join(found, key, "left").select(*key, "seq", "ranges").mapInArrow(runs, f"_id {id_type}, _h long, run binary, open boolean, pos int, end int, begin int, stop int")
    held = settle(held, "runs")
    firsts = held.groupBy("run").agg(F.min(me).alias("first"), F.max(F.when(F.col("open"), F.col("_id"))).alias("last")).filter("first._id < last")
    firsts = settle(firsts.select("run", "first"), "firsts")
    more = round_of(held.filter("open").join(firsts, "run").filter("first._id < _id"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merged([(r["start"], r["end"]) for r in x.as_py()]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ranges(out)], names=["_id", "_h", "_deleted"])

    every = found.unionByName(more).groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    per_doc = settle(every.mapInArrow(joined, f"_id {id_type}, _h long, _deleted {RANGES}"), "ranges")
    discard(docs.sparkSession, lines, holders, shared, sequences, found, held, firsts)

    tagged = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"))
    cleaned = tagged.join(per_doc, key, "left")
    columns = [(_without(F.col("_row")[c], F.col("_deleted")) if c == text_col else F.col("_row")[c]).alias(c) for c in others(docs, "_deleted")]
    return cleaned.select(*columns, F.coalesce("_deleted", F.array().cast(RANGES)).alias("_deleted"))


def _without(text: Column, deleted: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, k: ~F.exists(deleted, lambda r: (r["start"] <= k) & (k <= r["end"])))
    return F.when(deleted.isNull(), text).otherwise(F.array_join(kept, "\n"))


def query(spark, sf_dir):
    from ._shared import table

    found = line_dedup(table(spark, sf_dir, "documents"))
    ranges = F.transform(F.array_sort("_deleted"), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return found.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"), F.array_join(ranges, ",").alias("deleted"))
