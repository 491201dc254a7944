"""Repair of conversation structure by a time-major dynamic program.

A repaired conversation is empty, or a system message at most and then pairs
of a user's and an assistant's message. The cheapest edits are found over
arrays (turn, conversation, state): conversations are bucketed by length, each
turn updates the costs of a whole bucket at once from the last turn to the
first, and the stored costs lead all its conversations forward again.

A task first sees of each row a byte that says all the program needs, then
the rows themselves in the same order, which it edits as they stream. So it
holds bytes, never texts, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle, table

SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
# What edits cost, and what an undeleted truncated row adds.
INSERT, REROLE, DELETE, LATE = 3, 3, 4, 3
#: States: nothing yet, after a system, a user's, an assistant's message. Rows begin with s, u, a or another letter.
START, S, U, A = range(4)
OTHER = 4
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = np.array(["", "", "user", "assistant"], dtype=object)
#: The message that may be inserted or assigned in each state.
NEXT = np.array([U, U, A, U])
#: Cells of the costs that are held at once (turns and conversations), unless one conversation has more.
CELLS = 1 << 21
NEVER = 1 << 29


def backward(role: np.ndarray, fault: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Least costs (turns + 1, conversations, states) of what follows, from time-major rows; rows that are not real cost nothing."""
    turns, n = role.shape
    costs = np.empty((turns + 1, n, 4), np.int32)
    costs[turns] = [0, 2 * INSERT, INSERT, 0]
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        more = np.where(fault[t] == TRUNCATED, LATE, 0) + np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), NEVER, 0)
        to_s = np.where(role[t] == S, more + after[:, S], NEVER)
        to_u = more + np.where(role[t] == U, 0, REROLE) + after[:, U]
        to_a = more + np.where(role[t] == A, 0, REROLE) + after[:, A]
        now = after + DELETE
        now[:, START] = np.minimum(now[:, START], np.minimum(to_s, to_u))
        now[:, S] = np.minimum(now[:, S], to_u)
        now[:, U] = np.minimum(now[:, U], to_a)
        now[:, A] = np.minimum(now[:, A], to_u)
        # insertions before the row: of one message or two
        u, a = now[:, U].copy(), now[:, A].copy()
        now[:, U] = np.minimum(u, INSERT + a)
        now[:, A] = np.minimum(a, INSERT + u)
        for state in (START, S):
            now[:, state] = np.minimum(now[:, state], INSERT + now[:, U])
        costs[t] = np.where(real[t][:, None], now, after)
    return costs


def forward(costs: np.ndarray, role: np.ndarray, fault: np.ndarray, real: np.ndarray):
    """The cheapest edits whose initials are first in ASCII: of each row the letter (0 if not real), the message it becomes, how many messages are inserted before it and the first of these; how many are inserted in the end and the first of these."""
    turns, n = role.shape
    letter, becomes, inserted, first = (np.zeros((turns, n), np.uint8) for _ in range(4))
    state, every = np.zeros(n, np.int64), np.arange(n)
    for t in range(turns):
        open_ = real[t].copy()
        more = np.where(fault[t] == TRUNCATED, LATE, 0) + np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), NEVER, 0)
        while open_.any():
            want, to = costs[t][every, state], NEXT[state]
            deleted = open_ & (DELETE + costs[t + 1][every, state] == want)
            entered = open_ & ~deleted & (INSERT + costs[t][every, to] == want)
            # a row is kept as what it is: as a system message only in the beginning
            as_s = open_ & ~deleted & ~entered & (state == START) & (role[t] == S) & (more + costs[t + 1][:, S] == want)
            kept = as_s | (open_ & ~deleted & ~entered & (role[t] == to) & (more + costs[t + 1][every, to] == want))
            moved = open_ & ~deleted & ~entered & ~kept
            for mask, said in ((deleted, b"D"), (kept, b"K"), (moved, b"R")):
                letter[t][mask] = said[0]
            first[t][entered & (inserted[t] == 0)] = to[entered & (inserted[t] == 0)]
            inserted[t][entered] += 1
            state = np.where(as_s, S, np.where(entered | kept | moved, to, state))
            becomes[t][kept | moved] = state[kept | moved]
            open_ = entered
    return letter, becomes, inserted, first, np.choose(state, [0, 2, 1, 0]).astype(np.uint8), NEXT[state].astype(np.uint8)


def solve(role: np.ndarray, fault: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Edits of the rows of all conversations, one after the other, with ``lengths`` rows each: of each row ``letter``, ``becomes``, ``inserted`` and ``first``, of each conversation ``cost``, ``tail`` and ``tail_first``."""
    rows = {k: np.zeros(len(role), np.uint8) for k in ("letter", "becomes", "inserted", "first")}
    convs = {"cost": np.zeros(len(lengths), np.int64), "tail": np.zeros(len(lengths), np.uint8), "tail_first": np.zeros(len(lengths), np.uint8)}
    begins = np.cumsum(lengths) - lengths
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket[lengths > 0]).tolist():
        members = np.flatnonzero((bucket == b) & (lengths > 0))
        step = max(1, CELLS >> b)
        for k in range(0, len(members), step):
            some = members[k : k + step]
            t = np.arange(int(lengths[some].max()))[:, None]
            real = t < lengths[some][None]
            at = np.where(real, begins[some][None] + t, 0)
            r, f = role[at], fault[at]
            costs = backward(r, f, real)
            *edits, tail, tail_first = forward(costs, r, f, real)
            for name, m in zip(rows, edits, strict=True):
                rows[name][at[real]] = m[real]
            convs["cost"][some], convs["tail"][some], convs["tail_first"][some] = costs[0, :, START], tail, tail_first
    return rows | convs


def audits(letter: np.ndarray, inserted: np.ndarray, lengths: np.ndarray, tail: np.ndarray) -> list[str]:
    """The initials of each conversation's edits, in order."""
    ends = np.cumsum(lengths)
    each = inserted.astype(np.int64) + 1
    each_tail = np.zeros(len(letter) + 1, np.int64)
    np.add.at(each_tail, ends, tail.astype(np.int64))  # inserted before the row at which the next conversation begins
    at = np.cumsum(each + each_tail[:-1]) - 1
    total = int(each.sum() + each_tail.sum())
    said = np.full(total, b"I"[0], np.uint8)
    said[at] = letter
    stop = np.concatenate([[0], np.cumsum(each)])[ends] + np.cumsum(tail.astype(np.int64))
    raw = said.tobytes().decode()
    return [raw[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


class _Codes:
    """What a task holds of its rows: a byte each, and sums of each conversation."""

    SUMS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.ids, self.codes, self.sums, self.count = [], [], [], 0

    def add(self, b: pa.RecordBatch) -> None:
        column = lambda c: b.column(b.schema.get_field_index(c))
        value = lambda c: column(c).to_numpy(zero_copy_only=False)
        begins = value("_n") == 1
        seg = self.count + np.cumsum(begins) - 1
        self.ids.append(column("_conv").filter(pa.array(begins)))
        self.count += int(begins.sum())
        there, fault = value("_present"), value("_fault")
        self.codes.append((value("_role") | fault << 3).astype(np.uint8)[there])
        # a conversation may go on from the batch before: its sums are added up in the end
        starts = np.flatnonzero(np.diff(seg, prepend=seg[0] - 1))
        flags = np.column_stack([there, *[there & (fault == k) for k in (BLANK, DUPLICATE, TRUNCATED)], value("_illegal"), value("_new_turn")]).astype(np.int64)
        turn, far = pc.fill_null(column("_turn"), 0).to_numpy(zero_copy_only=False), np.iinfo(np.int64)
        new = value("_new_turn")
        low = np.minimum.reduceat(np.where(new, turn, far.max), starts)
        high = np.maximum.reduceat(np.where(new, turn, far.min), starts)
        self.sums.append((seg[starts], np.add.reduceat(flags, starts), low, high))

    def close(self):
        far = np.iinfo(np.int64)
        total, low, high = np.zeros((self.count, 6), np.int64), np.full(self.count, far.max), np.full(self.count, far.min)
        for seg, flags, lo, hi in self.sums:
            total[seg] += flags
            low[seg], high[seg] = np.minimum(low[seg], lo), np.maximum(high[seg], hi)
        sums = dict(zip(self.SUMS, total.T, strict=True))
        sums["gaps"] = np.where(sums["turns"] > 0, high - low + 1 - sums["turns"], 0)
        codes = np.concatenate(self.codes)
        return pa.concat_arrays(self.ids), codes & 7, codes >> 3, sums


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MESSAGE = "step long, edit string, role string, text string"
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _summary_rows(ids: pa.Array, sums: dict, edits: dict) -> Iterator[pa.RecordBatch]:
    said = audits(edits["letter"], edits["inserted"], sums["n"], edits["tail"])
    sums["cost"] = edits["cost"]
    for k in range(0, len(ids), 10_000):
        part = slice(k, k + 10_000)
        n = len(said[part])
        none = [pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.string())] * 3]
        yield pa.RecordBatch.from_arrays([ids[part], *none, *[pa.array(sums[c][part]) for c in COUNTS], pa.array(said[part], pa.string())], names=["_conv", *[x.split()[0] for x in f"{MESSAGE}, {SUMMARY}".split(", ")]])


def _message_rows(b: pa.RecordBatch, edits: dict, rows: slice, conv: np.ndarray, last: np.ndarray, step: int) -> tuple[pa.RecordBatch, int]:
    """A batch's rows with what is inserted around them; ``step`` counts the edits of the conversation that is not over."""
    column = lambda c: b.column(b.schema.get_field_index(c))
    before = edits["inserted"][rows].astype(np.int64)
    after = np.where(last, edits["tail"][conv], 0).astype(np.int64)
    each = before + 1 + after
    at = np.repeat(np.arange(len(each)), each)
    place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    own, tail = place == before[at], place > before[at]
    edit = np.where(own, edits["letter"][rows][at], b"I"[0])
    # inserted messages follow each other as user, assistant: the k-th is the first's turn moved on by k
    k = np.where(tail, place - before[at] - 1, place)
    first = np.where(tail, edits["tail_first"][conv][at], edits["first"][rows][at])
    role = np.where(own, edits["becomes"][rows][at], np.where(k % 2 == 0, first, np.where(first == U, A, U)))
    roles = np.where(own & (edit != b"R"[0]), None, NAMES[role])
    given = pa.array(np.where(own, at, 0))
    own_ = pa.array(own)
    role_column = pc.if_else(pc.is_null(pa.array(roles, pa.string())), column("role").take(given), pa.array(roles, pa.string()))
    text = pc.if_else(own_, column("text").take(given), pa.scalar("", pa.string()))
    begin = np.cumsum(each) - each
    fresh = column("_n").to_numpy(zero_copy_only=False) == 1
    counted = np.where(fresh, begin, -1)
    base = np.maximum.accumulate(np.where(counted < 0, -step, counted))  # where the row's conversation begins in this batch
    steps = np.arange(len(at)) - base[at]
    letters = np.array(["D", "I", "K", "R"], dtype=object)[np.searchsorted(np.frombuffer(b"DIKR", np.uint8), edit)]
    none = [*[pa.nulls(len(at), pa.int64())] * len(COUNTS), pa.nulls(len(at), pa.string())]
    out = pa.RecordBatch.from_arrays([column("_conv").take(pa.array(at)), pa.array(steps), pa.array(letters, pa.string()), role_column, text, *none], names=["_conv", *[x.split()[0] for x in f"{MESSAGE}, {SUMMARY}".split(", ")]])
    return out, int(steps[-1]) + 1


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of all rows of a task, then the rows: summaries, then edited messages."""
    codes, edits, seen = _Codes(), None, 0
    step, conv_rows, ends, whole = 0, None, None, None
    for batch in batches:
        passes = batch.column(batch.schema.get_field_index("_pass")).to_numpy(zero_copy_only=False)
        few = int((passes == 0).sum())
        if few:
            codes.add(batch.slice(0, few))
        if few == batch.num_rows:
            continue
        if edits is None:
            ids, role, fault, sums = codes.close()
            edits = solve(role, fault, sums["n"])
            yield from _summary_rows(ids, sums, edits)
            ends = np.cumsum(sums["n"])
            whole = len(role)
        rest = batch.slice(few)
        place = np.arange(seen, seen + rest.num_rows)
        conv_rows = np.searchsorted(ends, place, side="right")
        out, step = _message_rows(rest, edits, slice(seen, seen + rest.num_rows), conv_rows, place + 1 == ends[conv_rows], step)
        seen += rest.num_rows
        yield out
    if edits is None and codes.count:
        ids, role, fault, sums = codes.close()
        yield from _summary_rows(ids, sums, solve(role, fault, sums["n"]))
    assert whole is None or seen == whole


def marked(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Rows numbered within their conversation, with their role's and their fault's codes; one shuffle, by conversation."""
    blank_if_null = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), blank_if_null("role").alias("role"), blank_if_null("text").alias("text"), F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("_present"))
    order = Window.partitionBy("_conv").orderBy(F.desc("_present"), F.asc_nulls_first("_turn"), "role", "text")
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("_same", same).withColumn("_n", F.row_number().over(order)).withColumn("_initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("_initial").over(order), "_initial")
    rows = rows.withColumn("_illegal", F.coalesce(F.col("_present") & ~pair.isin("su", "ua", "au"), F.lit(False)))
    rows = rows.withColumn("_new_turn", F.coalesce(F.col("_present") & F.col("_turn").isNotNull() & ~F.lag("_turn").over(order).eqNullSafe(F.col("_turn")), F.lit(False)))
    again = F.row_number().over(Window.partitionBy("_conv", "_present", "_same").orderBy("_n")) > 1
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(~F.col("text").rlike(NOT_SPACE), BLANK).when(again, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    role = F.when(F.col("_initial") == "s", S).when(F.col("_initial") == "u", U).when(F.col("_initial") == "a", A).otherwise(OTHER)
    return rows.withColumn("_fault", fault.cast("int")).withColumn("_role", role.cast("int")).drop("_same", "_initial")


def repair(conversations: DataFrame, present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and edits (conv_id, step, edit, role, text) of conversations (conv_id, turn, role, text).

    Rows go by turn, nulls first, then role and text. A null role or text is
    one space. A row's first fault counts: blank; a duplicate of an earlier
    row's role and text; truncated, if its last character that is not a space
    ends no sentence. The cheapest edits bring the roles' initials into the
    form of a repaired conversation, of equally cheap ones those whose
    initials (Delete, Insert, Keep, Rerole) are first in ASCII; ``step`` counts
    them from 0. A role with another initial, or none, cannot be kept.

    Rows where ``present`` is not true only announce their conversation; one
    without rows has counts of 0 and no edits. A null conversation id is an id
    like any other; texts of any length stream through; other columns are
    ignored; an empty table gives empty ones. A conversation's rows are
    sorted in one task, which holds about 40 bytes of each while it edits.
    """
    rows = marked(conversations, present).withColumn("_pass", F.explode(F.array(F.lit(0), F.lit(1)))).filter("_pass = 0 OR _present")
    text = [F.when(F.col("_pass") == 1, F.col(c)).alias(c) for c in ("role", "text")]
    rows = rows.select("_pass", "_conv", "_n", "_present", "_role", "_fault", "_illegal", "_new_turn", "_turn", *text).sortWithinPartitions("_pass", "_conv", "_n")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    found = settle(rows.mapInArrow(_edit, f"_conv {kind}, {MESSAGE}, {SUMMARY}"), "repaired")
    summary = found.filter("step IS NULL").select(F.col("_conv").alias("conv_id"), *COUNTS, "audit")
    return summary, found.filter("step IS NOT NULL").select(F.col("_conv").alias("conv_id"), "step", "edit", "role", "text")


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each repaired conversation's ``role:text`` lines; lines are brought together in order and hashed as they stream."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    lines = edits.filter("edit != 'D'").select("conv_id", "step", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.withColumn("first", F.row_number().over(Window.partitionBy("conv_id").orderBy("step")) == 1)

    def run(batches):
        held, name = None, None
        for b in batches:
            ids, out = [], []
            for k, (line, first) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if first:
                    if held is not None:
                        ids.append(name)
                        out.append(held.hexdigest())
                    held, name = hashlib.sha256(line), b.column(0)[k].as_py()
                else:
                    held.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(out, pa.string())], names=["conv_id", "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], b.column(0).type), pa.array([held.hexdigest()])], names=["conv_id", "sha256"])

    return lines.select("conv_id", "line", "first").mapInArrow(run, f"conv_id {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Seeded faults: by the digest of ``conv_id:turn`` a row in 20 each is dropped (``present`` is false), emptied, robbed of its sentence ends, doubled, or said by the user."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("h", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("present"), copies.alias("copy")).drop("copy")


def query(spark, sf_dir):
    summary, edits = repair(damage(table(spark, sf_dir, "conversations")), F.col("present"))
    found = digests(edits).withColumnRenamed("conv_id", "_id")
    sha = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return summary.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select("conv_id", *COUNTS, "audit", sha)


def _add(v: str, cost: str, letter: str) -> str:
    """In SQL a cost of six digits and the initials so far are one text, so the least text is the cheapest and first."""
    return f"(lpad((left({v}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({v}, 7) || {letter})"


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
_INSERTED_U = f"least(vu, {_add('v0', '3', repr('I'))}, {_add('vs', '3', repr('I'))}, {_add('va', '3', repr('I'))})"
ORACLE = f"""WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c FROM (SELECT *, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS c FROM d0 WHERE h <> 0)),
n AS (SELECT *, row_number() OVER w AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS seen, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM n),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS t, '000000' AS v0, NULL::VARCHAR AS vs, NULL::VARCHAR AS vu, NULL::VARCHAR AS va FROM f
UNION ALL SELECT conv_id, t, {_add('v0', '4', repr('D'))}, least({_add('vs', '4', repr('D'))}, CASE WHEN kept AND i = 's' THEN {_add('v0', 'late', repr('K'))} END),
least({_add('iu', '4', repr('D'))}, CASE WHEN kept THEN {_add('least(v0, vs, ia)', "late + CASE WHEN i = 'u' THEN 0 ELSE 3 END", "CASE WHEN i = 'u' THEN 'K' ELSE 'R' END")} END),
least({_add('ia', '4', repr('D'))}, CASE WHEN kept THEN {_add('iu', "late + CASE WHEN i = 'a' THEN 0 ELSE 3 END", "CASE WHEN i = 'a' THEN 'K' ELSE 'R' END")} END)
FROM (SELECT *, least(va, {_add('iu', '3', repr('I'))}) AS ia FROM (SELECT f.conv_id, f.t, v0, vs, vu, va, i, fault NOT IN ('b', 'd') AS kept, CASE fault WHEN 't' THEN 3 ELSE 0 END AS late, {_INSERTED_U} AS iu FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.t = v.t + 1))),
e AS (SELECT conv_id, left(best, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM (SELECT conv_id, least(v0, va, {_add('iu', '3', repr('I'))}) AS best FROM (SELECT *, {_INSERTED_U} AS iu FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) = 1))),
l AS (SELECT conv_id, p, audit[p] AS letter FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM e)),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS t FROM l),
k AS (SELECT m.conv_id, p, letter, role, text, row_number() OVER (PARTITION BY m.conv_id ORDER BY p) AS k FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.t = m.t AND letter <> 'I' WHERE letter <> 'D'),
s AS (SELECT *, max((k = 1 AND letter = 'K' AND role[1] = 's')::INT) OVER (PARTITION BY conv_id) AS led FROM k),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM s GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""
