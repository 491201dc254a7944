import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import periodic_runs, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, size string, shard string, _g string, runs string, id string"


def docs(spark, *rows):
    """Rows (doc_id, text); further columns have names that clash with the operators' own."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS)


# ---- sharding


def plain_best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, k) for k, r in enumerate(room) if r >= s]
        k = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(capacity)
        room[k] -= s
    return room


def load(b):
    return sum(s * n for s, n in b.items())


def test_best_fit_of_classes_is_that_of_groups():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.choice([rng.randrange(8, 40), rng.randrange(8, 400)]) for _ in range(rng.randrange(1, 200))]
        capacity = rng.randrange(400, 900)
        assert [capacity - load(b) for b in sharding.plan(Counter(sizes), capacity=capacity)] == plain_best_fit(sizes, capacity)
        bins = sharding.plan(Counter(sizes), shards=24)
        assert sum((Counter(b) for b in bins), Counter()) == Counter(sizes) and len(bins) == 24
        loads = [load(b) for b in bins]
        if max(sizes) * 24 <= sum(sizes):  # else a group alone is more than an even share
            assert max(loads) - min(loads) <= max(min(b) for b in bins if load(b) == max(loads))
    assert sorted(load(b) for b in sharding.plan({10: 25}, shards=24)) == [10] * 23 + [20]
    own = sharding.plan({1000: 1, 8: 230}, shards=24)
    assert own[0] == {1000: 1} and all(b == {8: 10} for b in own[1:])
    assert sharding.plan({}, shards=3) == [{}, {}, {}]
    with pytest.raises(ValueError, match="a group of 9"):
        sharding.plan({9: 1}, capacity=8)


def test_tree_keeps_order():
    rng, tree, held = random.Random(5), sharding.Tree(), []
    for k in range(2000):
        held.append((rng.randrange(300), k))
        tree.add(*held[-1])
        if k % 2:
            size = rng.randrange(320)
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                held.remove(want)


def check_shards(rows, texts, shards):
    slots, of = {}, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert of.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_query(spark):
    rows = sharding.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    check_shards(rows, texts, 24)
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 8
    assert len(total) == 24 and max(total.values()) - min(total.values()) <= max(groups.values())


def test_sharding_edges(spark):
    long = "é long " * 300_000
    few = [(1, "a"), (2, None), (3, ""), (None, "b"), (None, "b"), (4, long), (4, long), (5, "\t\n")] + [(k, f"text {k % 40}" * (k % 40)) for k in range(100, 400)]
    rows = sharding.shard_groups(docs(spark, *few), shards=5).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in few)
    check_shards(rows, {**dict(few), None: "b"}, 5)
    again = sharding.shard_groups(docs(spark, *few).repartition(7), shards=5).collect()
    key = lambda rs: sorted(((r["doc_id"] or -1, r["shard"], r["slot"]) for r in rs))
    assert key(again) == key(rows)
    assert sharding.shard_groups(docs(spark, *few).limit(0)).count() == 0
    packed = sharding.shard_groups(docs(spark, *few[5:]), shards=None, capacity=3 * len(long.encode())).collect()
    check_shards(packed, dict(few), 3)


def test_sharding_of_hot_groups_and_shares(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHARE", 50)
    monkeypatch.setattr(sharding, "HOT", 8)
    few = [(k, "copy" if k % 3 == 0 else "x" * (k % 50)) for k in range(3000)]
    rows = sharding.shard_groups(docs(spark, *few), shards=6).collect()
    assert len(rows) == 3000
    check_shards(rows, dict(few), 6)


# ---- periodic runs


def brute_runs(ids):
    n, found = len(ids), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            stretch = ids[i : i + length]
            if j > i and length >= max(24, 3 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("long", [8192, 0])
def test_runs_against_brute_force(monkeypatch, long):
    monkeypatch.setattr(periodic_runs, "LONG", long)
    rng, many = random.Random(1), 0
    for _ in range(400):
        n, k = rng.randrange(160), rng.choice([1, 2, 3, 20])
        ids = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 9))):
                ids[i] = ids[i - p]
        want = brute_runs(ids)
        many += len(want)
        assert periodic_runs.find_runs(np.array(ids, np.int64)) == want
    assert many > 100


def plain_row(doc_id, text, plant):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if plant and doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2] or r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2]):
            best = r
    said = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], said, hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_runs_query(spark):
    got = [tuple(r) for r in periodic_runs.query(spark, SF).collect()]
    given = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = {r["doc_id"]: r["text"] for r in given if len(r["text"]) < 12_000}
    assert len(got) == len(given) and len(short) > 150 and any(r[1] for r in got)
    assert sorted(r for r in got if r[0] in short) == sorted(plain_row(k, t, True) for k, t in short.items())


def test_runs_edges(spark):
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "é x\x0by\x0cz " * 9, "a b " * 30, ("w " * 30 + "v " * 40) * 4, "p q r " * 8 + "p q " + "s t " * 20]
    few = [(k, t) for k, t in enumerate(texts)] + [(None, "b " * 30), (3, "one")]
    found = periodic_runs.periodic_runs(docs(spark, *few))
    got = found.select("doc_id", F.size("runs"), F.col("strongest.start"), F.col("strongest.length"), F.col("strongest.period"), F.lit(0), F.sha2(periodic_runs.listed("runs"), 256), F.sha2("collapsed", 256)).collect()
    want = [plain_row(k, t, False) for k, t in few]
    assert sorted(map(repr, ((*r[:5], *r[6:]) for r in map(tuple, got)))) == sorted(repr((*r[:5], *r[6:])) for r in want)
    assert {r["doc_id"]: r["collapsed"] for r in found.collect()}[5] == "a" and found.limit(0).count() == 0


def test_runs_of_very_long_texts(spark):
    words = [f"w{k * k % 9973}" for k in range(60_000)]
    words[20_000:45_000] = [f"p{k % 8000}" for k in range(25_000)]
    words[50_000:50_060] = ["x", "y"] * 30
    r = periodic_runs.periodic_runs(docs(spark, (1, " ".join(words)))).first()
    runs = [tuple(x) for x in r["runs"]]
    assert (20_000, 25_000, 8000) in runs and (50_000, 60, 2) in runs and tuple(r["strongest"]) == (50_000, 60, 2)
