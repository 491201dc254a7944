import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import conversation_repair as C

ROWS = "conv_id long, turn long, role string, text string, present boolean, step long, _n long"
FORM = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """Of rows (role, text) in order."""
    out, seen = [], set()
    for r in rows:
        words = r[1].strip(C.SPACES)
        out.append("b" if not words else "d" if r in seen else "t" if words[-1] not in ".!?" else "")
        seen.add(r)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines), by trying every sequence of edits with up to two insertions between rows."""
    kinds, best = faults(rows), None
    options = [["D"] if k in ("b", "d") else ["D", "K", "U", "A"] for k in kinds]
    for picks in itertools.product(*options):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(rows) + 1):
                for g in gaps[k]:
                    cost, audit, roles = cost + 3, audit + "I", roles + g
                    lines.append({"u": "user:", "a": "assistant:"}[g])
                if k < len(rows):
                    p, (role, text) = picks[k], rows[k]
                    if p == "D":
                        cost, audit = cost + 4, audit + "D"
                        continue
                    cost += (0 if p == "K" else 3) + (3 if kinds[k] == "t" else 0)
                    named = role if p == "K" else {"U": "user", "A": "assistant"}[p]
                    audit, roles = audit + ("K" if p == "K" else "R"), roles + (named[:1] or "?")
                    lines.append(f"{named}:{text}")
            if FORM.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain(rows):
    """The same by costs of prefixes, for rows of any number."""
    best, kinds = {"": (0, "", ())}, faults(rows)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(b):
        b = dict(b)
        for _ in range(3):
            for q, (cost, audit, lines) in list(b.items()):
                to = after[q]
                new = (cost + 3, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to]))
                b[to] = min(b.get(to, new), new)
        return b

    for (role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        for q, (cost, audit, lines) in closed(best).items():
            steps = [(q, 4, "D", ())]
            if kind not in ("b", "d"):
                late, to = 3 if kind == "t" else 0, after[q]
                if q == "" and role[:1] == "s":
                    steps.append(("s", late, "K", (f"{role}:{text}",)))
                steps.append((to, late, "K", (f"{role}:{text}",)) if role[:1] == to else (to, late + 3, "R", ({"u": "user:", "a": "assistant:"}[to] + text,)))
            for to, more, letter, line in steps:
                found = (cost + more, audit + letter, lines + line)
                new[to] = min(new.get(to, found), found)
        best = new
    ends = closed(best)
    return min(ends[q] for q in ("", "a") if q in ends)


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "", " ", "Up"]), rng.choice(["Yes.", "No!", "cut off", "", " \t", "why? ", "é.\n", f"{rng.random()}."])) for _ in range(n)]


def repaired(spark, convs, **options):
    data = [(k, t, *row, True, 1, 2) for k, rows in convs.items() for t, row in rows]
    return C.repair(spark.createDataFrame(data, ROWS), **options)


def check(summary, edits, want):
    """``want``: rows of each conversation, in order."""
    lines = {}
    for r in edits.filter("edit <> 'D'").orderBy("conv_id", "step").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    told = {r["conv_id"]: r["sha256"] for r in C.digests(edits).collect()}
    got = {r["conv_id"]: r for r in summary.collect()}
    steps = Counter((r["conv_id"], r["step"]) for r in edits.collect())
    assert set(got) == set(want) and set(steps.values()) <= {1}
    for k, rows in want.items():
        cost, audit, said = plain(rows)
        kinds = Counter(faults(rows))
        r = got[k]
        assert (r["cost"], r["audit"], lines.get(k, [])) == (cost, audit, list(said))
        assert told.get(k) == (hashlib.sha256("\n".join(said).encode()).hexdigest() if said else None)
        assert (r["blank"], r["duplicate"], r["truncated"]) == (kinds["b"], kinds["d"], kinds["t"])
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        assert {s for c, s in steps if c == k} == set(range(len(audit)))


def test_plain_version_against_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = some_rows(rng, rng.randrange(4))
        cost, audit, lines = plain(rows)
        assert (cost, audit, list(lines)) == cheapest(rows)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_repair_against_plain_version(spark, batch):
    rng = random.Random(7)
    want = {k: some_rows(rng, rng.randrange(1, 12)) for k in range(300)} | {None: some_rows(rng, 40), 999: some_rows(rng, 700)}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        if batch < 100:
            want.pop(999)
        summary, edits = repaired(spark, {k: list(enumerate(rows)) for k, rows in want.items()})
        check(summary, edits, want)
        assert {r["gaps"] for r in summary.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_repair_edges(spark):
    long = "Long é text " * 100_000 + "."
    convs = {
        1: [(0, ("user", long)), (2, ("assistant", long)), (5, ("user", long))],  # the third repeats the first
        2: [(None, ("user", "A.")), (None, ("assistant", "B.")), (7, ("user", "A.")), (7, ("user", "A."))],
        3: [(3, ("system", "S."))],
        4: [(1, ("", "x.")), (2, ("Sys", "y."))],
        None: [(1, ("user", "q?"))],
    }
    # rows without a turn come first, then by role
    want = {k: [r for _, r in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))] for k, v in convs.items()}
    summary, edits = repaired(spark, convs)
    check(summary, edits, want)
    assert {r["conv_id"]: r["gaps"] for r in summary.collect()} == {1: 3, 2: 0, 3: 0, 4: 0, None: 0}
    nulls = spark.createDataFrame([(1, 1, None, None), (1, 2, "user", None), (2, None, None, "a")], "conv_id long, turn long, role string, text string")
    check(*C.repair(nulls), {1: [(" ", " "), ("user", " ")], 2: [(" ", "a")]})
    absent = spark.createDataFrame([(1, 1, "user", "a.", False, 0, 0), (2, 1, "user", "a.", None, 0, 0), (3, 1, "user", "b", True, 0, 0)], ROWS)
    summary, edits = C.repair(absent, F.col("present"))
    got = {r["conv_id"]: (r["cost"], r["audit"], r["gaps"]) for r in summary.collect()}
    assert got == {1: (0, "", 0), 2: (0, "", 0), 3: (4, "D", 0)}
    assert C.digests(edits).count() == 0 and summary.count() == 3
    summary, edits = C.repair(absent.limit(0))
    assert summary.count() == edits.count() == C.digests(edits).count() == 0


def test_long_conversation_in_chunks(monkeypatch):
    monkeypatch.setattr(C, "CELLS", 64)
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(0, 9, 200), [300, 0, 17]])
    n = int(lengths.sum())
    role, fault = rng.integers(1, 5, n).astype(np.uint8), rng.integers(0, 4, n).astype(np.uint8)
    few = C.solve(role, fault, lengths)
    monkeypatch.setattr(C, "CELLS", 1 << 21)
    many = C.solve(role, fault, lengths)
    assert all((few[k] == many[k]).all() for k in few)
    said = C.audits(many["letter"], many["inserted"], lengths, many["tail"])
    costs = {"D": 4, "I": 3, "R": 3, "K": 0}
    at = 0
    for k, audit in enumerate(said):
        letters = audit.replace("I", "")
        assert len(letters) == lengths[k]
        late = sum(3 for j, c in enumerate(letters) if c != "D" and fault[at + j] == C.TRUNCATED)
        assert sum(costs[c] for c in audit) + late == many["cost"][k]
        at += lengths[k]


def test_damage(spark):
    data = [(c, t, r, x) for c in (1, 2, None) for t in (*range(60), None) for r, x in (("assistant", "One. Two!"), (None, None))]
    got = Counter(tuple(r) for r in C.damage(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, r, x in data:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        want[(c, t, "user" if h == 4 else r, x, h != 0)] += 2 if h == 3 else 1
    assert got == want
