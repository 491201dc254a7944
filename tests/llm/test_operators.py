import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from oracle import compare
from pyspark.sql import functions as F

from codeloom.llm import _shared, catalog, chat_format, components, exact_dedup, knn, language_id, line_dedup, mixing, packing, secret_scan, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string"


def docs(spark, *rows):
    """Rows (doc_id, text, lang); further columns have names that clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src1", 0, "x", "y") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- exact dedup


def test_exact_dedup_edges(spark):
    found = exact_dedup.exact_dedup(docs(spark, (1, "A b"), (2, "a B"), (2, "a b"), (3, None), (None, ""), (5, "É"), (6, "é")))
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept") == sorted(
        [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 3, 2, True), (None, 3, 2, False), (5, 5, 1, True), (6, 6, 1, True)], key=repr
    )
    assert exact_dedup.exact_dedup(docs(spark, (1, "a")).limit(0)).count() == 0


def test_exact_dedup_of_long_and_repeated_rows(spark):
    long = "Long text \u00e9 " * 200_000
    found = exact_dedup.exact_dedup(docs(spark, (1, long), (2, long.upper().replace("\u00c9", "\u00e9")), (2, long), (3, long + "x"), (4, "a"), (4, "a")).withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(0)))
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept") == sorted([(1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (4, 4, 2, False), (4, 4, 2, True)], key=repr)


def test_exact_dedup_compares_content_where_digests_clash(spark):
    data = docs(spark, *[(k, f"text {k % 7}") for k in range(60)])
    weak = exact_dedup.exact_dedup(data, digest=lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(2)).cast("string"))
    assert rows_of(weak, "doc_id", "keep_id", "group_size") == rows_of(exact_dedup.exact_dedup(data), "doc_id", "keep_id", "group_size")


# ---- secrets


def brute_secrets(text):
    found = []
    for kind, pattern in (("assign", secret_scan.ASSIGN), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.ASCII):
            if {"assign": len(m[2]) >= 6 if m.re.groups else False, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                found.append((m.start(), kind, m.end()))
    return found


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(3)
    parts = ["password = hunter22", "token:abc", "secret=token :abcdefgh", "AKIA" + "A1" * 9, "AKIA12", "deadbeef" * 4, "𝒳é ", "api_key='Zz9.yy-x'", "client_id: bob", "https://db.example.com:5432", "Q" * 44, "\n", " "]
    data = [(k, "".join(rng.choice(parts) + " " for _ in range(rng.randrange(0, 12)))) for k in range(150)]
    found = secret_scan.scan_secrets(docs(spark, *data, (900, None), (900, "password=secret99")))
    texts = dict(data)
    for r in found.filter("doc_id < 900").collect():
        base = [(x["start"], x["kind"], x["end"]) for x in r["found"] if x["kind"] in secret_scan.BASE]
        assert sorted(base) == sorted(brute_secrets(texts[r["doc_id"]]))
    assert sorted(len(r["found"]) for r in found.filter("doc_id = 900").collect()) == [0, 1]


def test_weak_parts_need_their_complements(spark):
    far = " x" * 300
    found = secret_scan.scan_secrets(docs(spark, (1, "client_id: bob " + "Q" * 44), (2, "client_id: bob"), (3, "Q" * 44 + far + "client_id: bob"), (4, "https://h.example:1 client_id: bob password=hunter22")))
    kinds = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in found.collect()}
    assert kinds == {1: ["ident", "long"], 2: [], 3: [], 4: ["endpoint", "ident", "assign"]}


def slow_links(text):
    """Weak spans with disjoint parts of every role that they need, by all combinations."""
    parts = [(m.start(), m.end(), k) for k, pattern in (("ident", secret_scan.IDENT), ("long", secret_scan.LONG), ("endpoint", secret_scan.ENDPOINT)) for m in re.finditer(pattern, text, re.ASCII)]
    parts += [(a, e, k) for a, k, e in brute_secrets(text)]
    role = {k: v[1] for k, v in (secret_scan.BASE | secret_scan.WEAK).items()}
    apart = lambda x, y: x[1] <= y[0] or y[1] <= x[0]
    out = []
    for p in parts:
        if p[2] in secret_scan.WEAK:
            near = [[q for q in parts if role[q[2]] == r and abs(q[0] - p[0]) <= secret_scan.SCOPE and apart(p, q)] for r in secret_scan.WEAK[p[2]][2]]
            if any(all(apart(x, y) for x, y in itertools.combinations(c, 2)) for c in itertools.product(*near)):
                out.append((p[0], p[2], p[1]))
    return sorted(out)


def test_links_need_disjoint_parts(spark):
    rng = random.Random(9)
    parts = ["login=", "account: ", "deadbeef" * 3, "Q" * 41, "https://h.example/", "AKIA" + "B2" * 8, "password=hunter22", " ", " ", "\n", "x " * 60, "client_id=bob"]
    data = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for k in range(250)]
    data += [(900, "account: " + "Q" * 44), (901, "login=" + "ab12" * 6), (902, "login=bob " + "ab12" * 6), (903, "https://x.example login=" + "ab12" * 6)]
    found = {r["doc_id"]: sorted((x["start"], x["kind"], x["end"]) for x in r["found"] if x["kind"] in secret_scan.WEAK) for r in secret_scan.scan_secrets(docs(spark, *data)).collect()}
    assert found == {k: slow_links(t) for k, t in data}
    assert found[900] == [] and found[901] == [] and [x[1] for x in found[902]] == ["ident"] and found[903] == []


def test_secrets_without_broadcasts(spark):
    """No join is forced to broadcast: beyond the threshold they shuffle, with the same result."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = rows_of(secret_scan.scan_secrets(d), "doc_id", "found")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = secret_scan.scan_secrets(d)
        assert rows_of(found, "doc_id", "found") == want
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_secret_edges(spark):
    long = "client_id: bob " + "password=hunter22 " * 60_000
    twice = (2, "token=abcdefgh AKIA" + "A1" * 9)
    found = scan = secret_scan.scan_secrets(docs(spark, (1, long), twice, twice).withColumn("found", F.lit(1)))
    assert scan.columns == ["doc_id", "found"] and [len(r["found"]) for r in found.orderBy("doc_id").collect()] == [60_001, 2, 2]
    assert secret_scan.scan_secrets(docs(spark, twice).limit(0)).count() == 0


# ---- chats


def test_events_fold(spark):
    log = [(1, 1, "start", 1, "user", "hi"), (1, 2, "start", 2, "assistant", ""), (1, 3, "delta", 2, None, "a"), (1, 4, "delta", 2, None, "b"), (1, 5, "start", 3, "user", "more"), (1, 6, "edit", 1, None, "hello"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "c"), (None, 1, "start", 1, None, None)]
    found = chat_format.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, msg_id long, role string, text string"))
    assert rows_of(found, "conv_id", "position", "role", "text") == sorted([(1, 0, "user", "hello"), (1, 1, "assistant", "c"), (None, 0, "", "")], key=repr)


def slow_fold(events):
    """Event by event, as an editor would hold a conversation."""
    shown = {}  # message: [begun, role, text]
    for seq, _, kind, msg, role, text in sorted(events, key=lambda e: (e[0], {"start": 0, "regenerate": 1, "edit": 2}.get(e[2], 3))):
        if kind == "regenerate":
            shown = {m: x for m, x in shown.items() if m == msg or x[0] <= (shown[msg][0] if msg in shown else seq)}
        x = shown.setdefault(msg, [seq, "", ""])
        x[1] = x[1] or role or ""
        x[2] = {"start": text, "edit": text, "delta": x[2] + (text or ""), "regenerate": ""}[kind] or ""
    return [(x[1], x[2]) for x in sorted(shown.values())]


def test_events_fold_against_slow(spark):
    rng = random.Random(8)
    logs = {}
    for c in range(40):
        seqs, open_ = itertools.count(), []
        log = logs[c] = []
        for m in range(rng.randrange(1, 8)):
            log.append((next(seqs), c, "start", m, rng.choice(["user", "assistant"]), rng.choice(["", None, "a"])))
            open_.append(m)
            for _ in range(rng.randrange(6)):
                kind = rng.choice(["delta", "delta", "edit", "regenerate"])
                of = rng.choice(open_)
                if kind == "regenerate":
                    open_ = [x for x in open_ if x <= of]
                log.append((next(seqs), c, kind, of, None, None if kind == "regenerate" else rng.choice("xyz")))
    rows = [(c, e[0], *e[2:]) for c, log in logs.items() for e in log]
    rng.shuffle(rows)
    found = chat_format.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg_id long, role string, text string")).collect()
    for c, log in logs.items():
        assert [(r["role"], r["text"]) for r in sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["position"])] == slow_fold(log)


def test_log_of_a_table_has_every_kind_and_folds_back(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c} {t} " * (t + 1)) for c in range(20) for t in range(6)] + [(50, 0, "user", "é" * 300_000), (50, 1, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg_id", F.lit(1))
    log = chat_format.to_events(table, 16)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    assert rows_of(chat_format.fold_events(log), "conv_id", "position", "role", "text") == sorted(rows, key=repr)
    assert chat_format.render(chat_format.fold_events(chat_format.to_events(table.limit(0)))).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<|", "im_end|>", "\\", "|", "<", "\n", "é", "n", "<|im_sep|>", "𝒳"]
    rows = [(c, t, rng.choice(["user", "assistant", "a<|b\\", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) or None) for c in range(12) for t in range(rng.randrange(1, 6))]
    rows += rows[:3]
    done = chat_format.render(chat_format.fold_events(chat_format.to_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 3)))
    got = {r["conv_id"]: ([(x["role"], x["text"]) for x in r["t"]], r["l"]) for r in done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("pieces"), F.col("loss")).alias("l")).collect()}
    for c in range(12):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or ""))]
        assert got[c] == (want, "".join(t for role, t in want if role == "assistant"))


# ---- WARC


def test_warc_round_trip_and_selection(spark):
    data = [(3, "http://a/\r\nb", "<p>é\r\n\r\nx</p>"), (1, None, "<p>é\r\n\r\nx</p>"), (2, "u", None), (4, "v", ""), (None, "w", "long " * 50_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    folder = _shared.new_folder(spark, "warc")
    index = warc.write_archives(pages, folder)
    back = {r["page_id"]: r for r in warc.read_archives(index, folder, most=1000).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in back.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("revisit", 2), None: ("response", None)}
    assert bytes(back[1]["payload"]).decode() == data[1][2] and back[None]["payload_bytes"] == 250_000
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode() for i, _, t in data for r in [back[i]])
    assert rows_of(warc.read_archives(index.filter("page_id = 3"), folder, payloads=False), "page_id") == [(3,)]
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0
    twice = warc.write_archives(pages.filter("page_id = 3").unionByName(pages.filter("page_id = 3")), folder)
    assert rows_of(warc.read_archives(twice, folder), "page_id", "record_type") == [(3, "response")] * 2


# ---- SimHash


def slow_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \t\x0b", "One", "a B c", "É a b c", "a b c d", "x\x85y a b c d e f g", "w " * 700 + "z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)


def components_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("block", "tau"), [(4096, 4), (3, 4), (3, 3)])
def test_links_against_all_pairs(spark, block, tau):
    rng = random.Random(block + tau)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(120):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components_of([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= tau], signed)
    found = components.connected_components(simhash.link(nodes, tau, block))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert {x: got.get(x, x) for x in signed} == want


@pytest.mark.parametrize(("block", "tau", "batch"), [(4096, 14, 10_000), (12, 6, 10_000), (6, 14, 10_000), (4096, 6, 16)])
def test_similar_links_against_all_pairs(spark, block, tau, batch):
    rng = random.Random(block + tau)
    rows = [(rng.getrandbits(64), rng.getrandbits(192), 100, [k % 3, 100 + k, 7]) for k in range(40)]
    for _ in range(200):
        x, y, size, least = rng.choice(rows)
        for b in rng.sample(range(64), rng.randrange(1, tau + 3)):
            x ^= 1 << b
        for b in rng.sample(range(192), rng.randrange(30, 46)):
            y ^= 1 << b
        rows.append((x, y, rng.choice([size, size, 90, 120]), rng.choice([least, [len(rows) + 1000], [least[0]]])))
    near = [
        (a, b) for (a, p), (b, q) in itertools.combinations(enumerate(rows), 2)
        if (p[0] ^ q[0]).bit_count() <= tau and (p[1] ^ q[1]).bit_count() <= 38 and min(p[2], q[2]) >= 0.8 * max(p[2], q[2]) and set(p[3]) & set(q[3])
    ]
    data = [(k, x - 2**64 if x >> 63 else x, y.to_bytes(24, "little"), size, least) for k, (x, y, size, least) in enumerate(rows)]
    frame = spark.createDataFrame(data, "node long, fp long, wide binary, size long, least array<long>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["node"]: r["root"] for r in components.connected_components(simhash.link_similar(frame, tau, 38, 0.8, block)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {k: got.get(k, k) for k in range(len(rows))} == components_of(near, range(len(rows)))


@pytest.mark.parametrize("room", [1, 7, 1000])
def test_link_groups_against_all_pairs(spark, room):
    """A chain, a clique and strangers in each group, whatever the blocks."""
    values = [(g, g * 1000 + k, v) for g in range(3) for k, v in enumerate([*range(40), *[500] * 60, *range(1000, 3000, 100)])]
    near = [(a[1], b[1]) for a, b in itertools.combinations(values, 2) if a[0] == b[0] and abs(a[2] - b[2]) <= 1]

    def compare(rows):
        a, b = rows.alias("a"), rows.alias("b")
        return a.join(b, [F.col("a.key") == F.col("b.key"), F.abs(F.col("a.v") - F.col("b.v")) <= 1]).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    frame = spark.createDataFrame(values, "grp long, node long, v long").withColumn("weight", F.lit(1))
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.link_groups(frame, room, compare)).collect()}
    nodes = [v[1] for v in values]
    assert {n: got.get(n, n) for n in nodes} == components_of(near, nodes)


def test_least_hashes_meet_at_a_similarity():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 360, dtype=np.uint64)
        a, b = simhash.least_hashes(np.sort(x[:320])), simhash.least_hashes(np.sort(x[40:]))  # 280 of 360 are common
        met += any(p == q for p, q in zip(a, b, strict=True))
        assert not set(a) & set(simhash.least_hashes(rng.integers(0, 2**63, 300, dtype=np.uint64)))
    assert met >= 298 and simhash.least_hashes(np.zeros(0, np.uint64)) == []


def test_near_copies_at_a_similarity(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [rng.choices(words, k=300) for _ in range(30)]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    for k, x in enumerate(texts):
        y = list(x)
        for at in (50, 120, 190, 260)[: k % 5]:  # each changed word changes five shingles of 296
            y[at] = "changed"
        rows.append((100 + k, " ".join(y)))
    found = simhash.near_dedup(docs(spark, *rows, (500, None), (501, " ")), shingle=5, tau=18, similarity=0.8)
    want = [(k, k % 100) for k, _ in rows] + [(500, 500), (501, 500)]
    assert rows_of(found, "doc_id", "component_id") == sorted(want, key=repr)


def test_near_copies_are_verified(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        x = rng.choices(words, k=300)
        y = list(x)
        for at in range(10, 290, 28)[: 10 if k % 2 else 6]:  # a Jaccard of 246 / 346 or 266 / 326
            y[at] = "changed"
        rows += [(k, " ".join(x)), (100 + k, " ".join(y))]
    # an equal set of shingles with other counts of them; two short texts
    rows += [(200, "a b c d e " * 3), (201, "a b c d e " * 30), (202, "a b c"), (203, "A  b c"), (204, "a b d")]
    found = simhash.near_dedup(docs(spark, *rows), shingle=5, tau=20, similarity=0.8)
    want = [(k, k % 100 if k < 200 and k % 2 == 0 else k) for k, _ in rows[:120]] + [(200, 200), (201, 200), (202, 202), (203, 202), (204, 204)]
    assert rows_of(found, "doc_id", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("block", [200, 1 << 19])
def test_verified_against_all_pairs(spark, block):
    rng = random.Random(block)
    sets = {bytes([0, 0]): set()}
    for k in range(1, 120):
        base = set(rng.choice(list(sets.values()))) if rng.random() < 0.8 else set()
        base = base or {rng.getrandbits(63) for _ in range(rng.randrange(5, 30))}
        for _ in range(rng.randrange(4)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.getrandbits(63))
        sets[bytes([k // 100, k % 100])] = base
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])]
    frame = spark.createDataFrame([(7, k, len(v), np.array(sorted(v), np.uint64).tobytes()) for k, v in sets.items()], "root long, set binary, size long, hashes binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in components.connected_components(simhash.verified(frame, 0.8, block)).collect()}
    assert {x: got.get(x, x) for x in sets} == components_of(near, list(sets))


def near_groups(texts, similarity=0.8, n=5):
    """Least id reachable over pairs of a Jaccard similarity, all pairs that share a shingle counted."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(" ".join(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([" ".join(words)] if words else [])
    holders = {}
    for s in set(sets.values()):
        for x in s:
            holders.setdefault(x, []).append(s)
    met = {}
    for group in holders.values():
        for a, b in itertools.combinations(group, 2):
            key = (a, b) if id(a) < id(b) else (b, a)
            met[key] = met.get(key, 0) + 1
    ids = {}
    for i, s in sets.items():
        ids.setdefault(s, []).append(i)
    links = [(g[0], x) for g in ids.values() for x in g[1:]]
    links += [(ids[a][0], ids[b][0]) for (a, b), c in met.items() if c * 10 >= (len(a) + len(b) - c) * 8]
    return components_of(links, sorted(texts)), len(links)


def test_near_dedup_of_what_line_dedup_hands_over(spark):
    d = line_dedup.line_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("_deleted")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    want, links = near_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(d, shingle=5, tau=18, similarity=0.8).collect()}
    assert links > 5
    assert [i for i in texts if got[i] != want[i]] == []
    assert all(want[got[i]] == want[i] for i in texts)  # nothing is linked that no chain of true links connects


def test_hot_shingles_bring_few_pairs(spark):
    """Nodes that share one shingle and no more: nothing is left to compare, however many they are."""
    rng = np.random.default_rng(2)
    for n in (5_000, 20_000):
        rows = [(k, int(fp), b"", 100, [7, *least]) for k, (fp, least) in enumerate(zip(rng.integers(-(2**62), 2**62, n).tolist(), rng.integers(0, 2**62, (n, simhash.ORDERS - 1)).tolist(), strict=True))]
        # and pairs that share three more
        rows += [(n + k, *rows[k][1:4], [7, *rows[k][4][1:4], *rng.integers(0, 2**62, simhash.ORDERS - 4).tolist()]) for k in range(100)]
        nodes = spark.createDataFrame(rows, "node long, fp long, wide binary, size long, least array<long>")
        groups = simhash.candidate_groups(nodes, 18, 1000).groupBy("grp").agg(F.collect_list("node").alias("x"))
        met = [r["x"] for r in groups.collect()]
        assert sum(len(x) * (len(x) - 1) // 2 for x in met) < 1000
        assert {(min(x), max(x)) for x in met if len(x) == 2} == {(k, n + k) for k in range(100)}


def test_recall_of_planted_pairs(spark, monkeypatch):
    """Pairs of a Jaccard similarity from 0.8 to 0.9 under a passage that all texts share, with groups small enough to be split."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    shared = rng.choices(words, k=60)
    rows, pairs = [], []
    for k in range(400):
        x = [*shared, *rng.choices(words, k=240)]
        y = list(x)
        at = rng.sample(range(66, 294, 6), rng.randrange(3, 7))  # each changes five shingles of 296
        for i in at:
            y[i] = f"new{k}"
        c = 296 - 5 * len(at)
        assert 0.8 <= c / (592 - c) <= 0.91
        rows += [(k, " ".join(x)), (1000 + k, " ".join(y))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs(spark, *rows), shingle=5, tau=18, similarity=0.8).collect()}
    found = sum(got[1000 + k] == k for k in range(400))
    assert found >= 380 and all(got[k] == k for k in range(400)) and all(got[1000 + k] in (k, 1000 + k) for k in range(400))


@pytest.mark.parametrize("block", [20, 4096])
def test_no_similar_pair_is_left_out(spark, monkeypatch, block):
    """Pairs of 0.8 that differ in many bits or share few least shingles: short texts, and longer ones under a passage that most share."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", 20, raising=False)
    monkeypatch.setattr(simhash, "FEW", 30, raising=False)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    shared, rows = rng.choices(words, k=40), []
    for k in range(80):
        x = rng.choices(words, k=9)
        rows += [(k, " ".join(x)), (1000 + k, " ".join(x[:8]))]  # 4 of 5 shingles
        x = [*shared, *rng.choices(words, k=rng.randrange(5, 60))]
        y = list(x)
        y[rng.randrange(45)] = "new"
        rows += [(2000 + k, " ".join(x)), (3000 + k, " ".join(y)), (4000 + k, " ".join(x[: len(x) * 9 // 10]))]
    rows += [(5000 + k, text) for k, (_, text) in enumerate(rows[:40])] + [(6000, None), (6001, " ")]
    want, _ = near_groups(dict(rows))
    got = dict(rows_of(simhash.near_dedup(docs(spark, *rows), shingle=5, tau=18, similarity=0.8), "doc_id", "component_id"))
    assert all(want[1000 + k] == k for k in range(80)) and got == want


def test_bounds_never_drop_a_similar_pair():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    hot = np.sort(rng.choice(pool, 300, replace=False))
    hot = hot, rng.integers(64, 99, 300)
    met = 0
    for t in (0.5, 0.8, 0.9):
        for _ in range(400):
            x = rng.choice(pool, rng.integers(1, 300), replace=False)
            y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(t, 1))), replace=False), rng.choice(pool, rng.integers(0, 1 + len(x) // 9))]))
            x = np.sort(x)
            common = len(np.intersect1d(x, y))
            if common < t * (len(x) + len(y) - common) - 1e-9:
                continue
            met += 1
            a, b = simhash.prefix(x, t, hot).tolist(), simhash.prefix(y, t, hot).tolist()
            first = next(h for h in a if h in set(b))
            assert simhash._allowed(*(np.array(v) for v in (len(x), a.index(first), len(y), b.index(first))), t)
            width = min(simhash.parity_width(len(x)), simhash.parity_width(len(y)))
            bits = [np.frombuffer(simhash._folded(simhash.parities(s), width), np.uint64) for s in (x, y)]
            assert simhash._parity_links(np.array(bits), np.array([len(x), len(y)]), t) == ([0], [1])
    assert met > 300


def test_simhash_query_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t or "") for i, t in texts.items()}
    want = components_of([(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4], sorted(fps))
    found = simhash.query(spark, SF).collect()
    assert len(found) == len(texts) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_near_dedup_edges(spark):
    assert simhash.near_dedup(docs(spark, (1, "a")).limit(0), similarity=0.8).count() == 0
    found = simhash.near_dedup(docs(spark, (4, None), (2, ""), (9, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (None, "a b c d e")))
    assert rows_of(found, "doc_id", "component_id") == sorted([(4, 2), (2, 2), (9, 7), (7, 7), (7, 7), (None, 7)], key=repr)
    assert simhash.near_dedup(docs(spark, (1, "a")).limit(0)).count() == 0


# ---- kNN


def test_knn_edges(spark):
    vectors = [(k, [float(k % 5), float(k % 3) - 1]) for k in range(40)] + [(40, None), (41, [1.0, None]), (42, [float("nan"), 1.0]), (20, [0.0, 1.0]), (43, [2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    usable = [(i, np.floor(64 * np.array([*v, 0.0][:2]))) for i, v in vectors if v and None not in v and not any(np.isnan(v))]
    want = []
    for i, q in usable:
        if i % 20 == 0:
            best = sorted(((-int(q @ x), j) for j, x in usable if j != i))[:5]
            want += [(i, s, j) for s, j in best]
    got = [(r["query_id"], -r["score"], r["vec_id"]) for r in knn.knn_join(df, "vec_id % 20 = 0", 5).collect()]
    # a repeated query row shares its id's answers
    assert set(got) == set(want)
    assert knn.knn_join(df.limit(0), "true").count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows_of(knn.knn_join(few, "vec_id % 20 = 0"), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 64 * 128)]


def test_knn_prunes_clusters(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 25)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.arange(4000) % 40] + rng.normal(0, 0.05, (4000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows, p, plan, q_blocks, blocks = knn.prepare(df, "vec_id % 20 = 0", 10, "vec_id", "embedding", 64, None)
    groups = len(plan[3])
    assert groups > 1 and knn.deal(rows, p, plan, q_blocks, blocks).count() < 0.2 * 4000 * groups
    # a query goes to the blocks of its group's rows, not to those of all
    monkeypatch.setattr(knn, "DATA_BLOCK", 100)
    _, _, plan, q_blocks, blocks = knn.prepare(df, "vec_id % 20 = 0", 10, "vec_id", "embedding", 64, None)
    copies = knn.ask(rows, plan, q_blocks, blocks).count()
    assert len(blocks) == len(q_blocks) > 1 and copies < 0.4 * 200 * 40 and max(blocks) < 20
    v = np.floor(64 * x).astype(np.int64)
    want = [(q, j, int(s[j])) for q in range(0, 4000, 20) for s in [v @ v[q]] for j in sorted((j for j in range(4000) if j != q), key=lambda j: (-s[j], j))[:10]]
    assert rows_of(knn.knn_join(df, "vec_id % 20 = 0", 10), "query_id", "vec_id", "score") == sorted(want, key=repr)


def test_knn_of_large_components(spark):
    frame = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    found = knn.knn_join(frame([1e7, 1.0], [2e7, 3.0], [1e7 + 1, 0.5]), "vec_id = 0")
    assert rows_of(found, "rank", "vec_id", "score") == [(1, 1, 64 * 64 * (2 * 10**14 + 3)), (2, 2, 64 * 64 * 10**7 * (10**7 + 1) + 64 * 32)]
    with pytest.raises(Exception, match="no 64-bit number"):
        knn.knn_join(frame([1e12, 1.0], [1e12, 1.0]), "vec_id = 0").collect()
    with pytest.raises(Exception, match="no finite number"):
        knn.knn_join(frame([1e308, 1.0], [1.0, 1.0]), "vec_id = 0").collect()
    assert knn.knn_join(frame([1.0, 1.0], [math.inf, 1.0]), "vec_id = 0").count() == 0


def test_knn_with_many_copies_of_a_query_id(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(200, 4)), 5 + rng.normal(0, 0.01, (60, 4)), 4 + rng.normal(0, 0.01, (5, 4))])
    ids = [*range(1, 201), *[0] * 60, *range(201, 206)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(np.int64)
    want = {(-int(v[q] @ v[j]), ids[j]) for q in range(200, 260) for j in sorted((j for j in range(len(x)) if ids[j]), key=lambda j: (-int(v[q] @ v[j]), ids[j]))[:20]}
    found = knn.knn_join(df, "vec_id = 0", 20, pivots=30).collect()
    asks = {tuple(v[q]) for q in range(200, 260)}  # each vector of the id asks once
    assert len(found) == len(asks) * 20 and {(-r["score"], r["vec_id"]) for r in found} == want


# ---- line dedup


def slow_line_dedup(data, least=5):
    """By all pairs of documents and all their diagonals: lines of a common run of ``least`` words with any earlier one go."""
    lines = {i: t.split("\n") for i, t in data}
    gone = {i: set() for i in lines}
    for o, i in itertools.permutations(lines, 2):
        if o < i:
            a, b = lines[o], lines[i]
            for d in range(-len(a), len(b) + 1):
                run = []
                for k in range(len(a) + 1):
                    if k < len(a) and 0 <= k + d < len(b) and a[k] == b[k + d] and a[k].strip():
                        run.append(k + d)
                    else:
                        if sum(len(b[j].split()) for j in run) >= least:
                            gone[i].update(run)
                        run = []
    return gone


@pytest.mark.parametrize(("seed", "lines", "n"), [(2, 14, 60), (3, 14, 150), (5, 40, 60)])
def test_line_dedup_against_all_pairs(spark, seed, lines, n):
    rng = random.Random(seed)
    pool = [f"line {k} of {'many ' * (k % 6)}words" for k in range(40)] + ["", "ok", "so it goes", "a b", "c"]
    data = [(k, "\n".join(rng.choice(pool[: rng.choice([8, 45])]) for _ in range(rng.randrange(0, lines)))) for k in range(n)]
    found = line_dedup.line_dedup(docs(spark, *data, (900, None), (None, data[0][1]))).collect()
    assert {(r["_id"], r["_h"]) for r in found} == {("x", "y")}
    got = {r["doc_id"]: r for r in found}
    assert got[900]["text"] is None and got[None]["text"] == data[0][1]
    want = slow_line_dedup(data)
    for k, text in data:
        out = [p for r in got[k]["_deleted"] for p in range(r["start"], r["end"] + 1)]
        assert out == sorted(want[k])
        assert got[k]["text"] == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in want[k])
    assert {x for _, t in data for x in t.split("\n")} - {""} == {x for k, _ in data for x in got[k]["text"].split("\n")} - {""}


def test_blocks_first_seen_apart_and_repeated_runs(spark):
    long = "\n".join(f"a line of this very long text, number {k}" for k in range(20_000))
    data = [(1, "alpha beta x"), (2, "gamma delta y"), (3, "alpha beta x\ngamma delta y"), (4, "alpha beta x\ngamma delta y"), (5, "one two three four five"), (6, "one two three four five\nnew\none two three four five"), (7, long), (8, long), (9, "")]
    found = line_dedup.line_dedup(docs(spark, *data, data[3]).withColumn("_Deleted", F.lit(1)))
    assert [c.lower() for c in found.columns].count("_deleted") == 1
    assert rows_of(found, "doc_id", "text") == sorted([*data[:3], (4, ""), (4, ""), (5, data[4][1]), (6, "new"), (7, long), (8, ""), (9, "")], key=repr)
    assert line_dedup.line_dedup(docs(spark, (1, "a")).limit(0)).count() == 0


def test_nothing_goes_without_alignment(spark, monkeypatch):
    """The runs' hashes only find pairs: with a patience diff that matches nothing, nothing is deleted."""
    data = docs(spark, (1, "one two three four five\nsix seven"), (2, "x\none two three four five\nsix seven\ny\none two three four five"))
    assert [r["_deleted"] for r in line_dedup.line_dedup(data).filter("doc_id = 2").collect()] == [[(1, 2), (4, 4)]]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.line_dedup(data).filter(F.size("_deleted") > 0).count() == 0
    assert line_dedup.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).filter(F.size("_deleted") > 0).count() == 0


def test_alignment_grows_with_its_block():
    rng = random.Random(6)
    for _ in range(200):
        early, late = ([(k, rng.choice("abcdefgh" * 2 + "xyz"), 3) for k in range(rng.randrange(5, 60))] for _ in range(2))
        common = [(k, f"c{k}", 3) for k in range(rng.randrange(2, 50))]
        i, j = rng.randrange(len(early)), rng.randrange(len(late))
        early = [(k, x[1], 3) for k, x in enumerate([*early[:i], *common, *early[i:]])]
        late = [(k, x[1], 3) for k, x in enumerate([*late[:j], *common, *late[j:]])]
        at = rng.randrange(len(common))
        for reach in (1, 2, 64):
            found = line_dedup.aligned_at(early, late, i + at, j + at, 5, reach)
            assert any(a <= j and j + len(common) - 1 <= b for a, b in found)
            assert all(line_dedup.merged([r]) == [r] for r in found)


def test_patience_without_unique_lines():
    rng = random.Random(4)
    assert len(line_dedup.patience(list("xaabby"), list("zbabaw"))) == 2
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(line_dedup._lcs(a, 0, len(a), b, 0, len(b)))
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))


def test_patience():
    assert line_dedup.patience(list("abcdef"), list("abxcdyef")) == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 6), (5, 7)]
    assert line_dedup.patience([], list("a")) == [] and line_dedup.patience(list("aa"), list("aa")) == [(0, 0), (1, 1)]


# ---- packing, mixing


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        hist = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        k, lengths = rng.randrange(1, 5), sorted(hist)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())  # noqa: E731, B023
        best = min(cost([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        found = packing.boundaries(hist, k)
        assert len(found) <= k and cost(found) == best


def test_pack(spark):
    rng = random.Random(4)
    data = [(k, "w " * rng.randrange(0, 60)) for k in range(80)] + [(5, None), (None, "a b"), (200, "w " * 1000)]
    rows = packing.pack(docs(spark, *data), max_len=64, buckets=3, token_budget=256).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for _, t in data)
    batches = {}
    for r in rows:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["pad_to"]
            batches.setdefault((r["bucket"], r["pad_to"], r["batch"]), []).append(r["row"])
        else:
            assert r["bucket"] is None
    for (b, pad, k), at in batches.items():
        room = max(1, 256 // pad)
        assert sorted(at) == list(range(len(at))) and (len(at) == room or k == max(x[2] for x in batches if x[0] == b))
    # pieces by their text's length: every one is there, under the least boundary that holds it
    want = sorted(((i, k, 64 * k, min(64, n - 64 * k)) for i, t in data for n in [len((t or "").split())] for k in range(max(1, -(-n // 64)))), key=repr)
    assert rows_of(packing.pack(docs(spark, *data), max_len=64, buckets=3, token_budget=256), "doc_id", "piece", "start_token", "n_tokens") == want
    hist = {}
    for *_, n in want:
        hist[n] = hist.get(n, 0) + 1
    bounds = packing.boundaries({n: c for n, c in hist.items() if n}, 3)
    assert all(r["pad_to"] == min(b for b in bounds if b >= r["n_tokens"]) and r["bucket"] == bounds.index(r["pad_to"]) for r in rows if r["n_tokens"])
    assert packing.pack(docs(spark, (1, "a")).limit(0)).count() == 0


def test_pack_ties_and_repeats(spark):
    same = [(7, "a b c")] * 5 + [(8, "a b c")] * 4
    rows = packing.pack(docs(spark, *same).withColumn("bucket", F.lit("x")), buckets=2, token_budget=6).collect()
    assert len(rows) == 9 and {(r["bucket"], r["pad_to"]) for r in rows} == {(0, 3)}
    assert sorted((r["batch"], r["row"]) for r in rows) == [(k // 2, k % 2) for k in range(9)]


def test_mix_shortages_go_to_siblings_first(spark):
    data = [(k, "w " * 10, "en" if k < 5 else "de" if k < 60 else None) for k in range(160)]
    d = docs(spark, *data).withColumn("source", F.when(F.col("doc_id") < 60, "a").otherwise("b"))
    levels = {"source": F.col("source"), "lang": F.col("lang")}
    found = mixing.mix(d, levels, {}, 0.5, 1, 3)
    # source a gets 400 of 800 tokens; its 'en' has only 50, so 'de' takes 350
    assert rows_of(found.groupBy("source", "lang").agg(F.sum("_tokens").alias("n")), "source", "lang", "n") == sorted([("a", "en", 50), ("a", "de", 350), ("b", None, 400)], key=repr)
    twice = mixing.mix(d, levels, {"source": {"a": 1, "b": 0}}, 0.5, 2, 3)
    assert twice.filter("source = 'b'").count() == 0 and twice.agg(F.sum("_tokens")).first()[0] == 800
    assert mixing.mix(d.limit(0), levels, {}).count() == 0


def slow_fill(children, given):
    """By bisection of the level to which all fill."""
    lo, hi = 0.0, max((cap / w for cap, w in children), default=0.0)
    if sum(cap for cap, _ in children) <= given:
        return [float(cap) for cap, _ in children]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap, mid * w) for cap, w in children) <= given else (lo, mid)
    return [min(cap, lo * w) for cap, w in children]


@pytest.mark.parametrize("n", [1, 7, 400])
def test_water_filling_against_bisection(spark, n):
    rng = random.Random(n)
    groups = {g: ([(rng.choice([10, rng.randrange(1, 10**6)]), rng.choice([0.5, 1.0, 3.0])) for _ in range(n)], rng.choice([0.2, 0.9, 1.5])) for g in range(5)}
    rows = [(g, k, cap, w, share * sum(c for c, _ in children)) for g, (children, share) in groups.items() for k, (cap, w) in enumerate(children)]
    frame = spark.createDataFrame(rows, "g long, k long, cap long, weight double, given double")
    got = {(r["g"], r["k"]): r["budget"] for r in mixing.share(frame, ["g"]).collect()}
    for g, (children, share) in groups.items():
        assert np.allclose([got[g, k] for k in range(n)], slow_fill(children, share * sum(c for c, _ in children)))
    alone = {r["k"]: r["budget"] for r in mixing.share(frame.filter("g = 0").drop("g"), []).collect()}
    assert np.allclose([alone[k] for k in range(n)], [got[0, k] for k in range(n)])


def test_mix_edges(spark):
    same = (5, "w w w", "en")
    d = docs(spark, (1, None), (2, ""), same, same, (6, "w " * 5000), (None, "w w")).withColumn("_Epoch", F.lit("x")).withColumn("_tokens", F.lit("y")).withColumn("_place", F.lit(0))
    found = mixing.mix(d, {"lang": F.col("lang")}, {}, 1.0, 1)
    assert [c.lower() for c in found.columns].count("_epoch") == 1 and found.columns.count("_tokens") == 1
    assert rows_of(found, "doc_id", "_tokens", "_epoch") == sorted([(5, 3, 0), (5, 3, 0), (6, 5000, 0), (None, 2, 0)], key=repr)


# ---- language


@pytest.fixture(scope="module")
def trained(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.fit(d.filter(~language_id.held_out(F.col("doc_id"))), steps=120), d


def test_language_held_out(trained):
    model, d = trained
    found = language_id.predict(d.filter(language_id.held_out(F.col("doc_id"))).select("doc_id", "lang", "text"), model)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def slow_label(model, text):
    """One byte at a time, each window of the text from a zero state in both directions."""
    width = model.recurrent.shape[2]

    def states(which, window):
        h, out = np.zeros(width), []
        for b in window:
            a, g = model.tables[which][:, b].astype(float), model.recurrent[which].astype(float) @ h
            z, r = (np.clip(a[k * width : (k + 1) * width] + g[k * width : (k + 1) * width], 0, 1) for k in (0, 1))
            n = r * g[2 * width :] + a[2 * width :]
            n = n / (1 + abs(n))
            h = n + z * (h - n)
            out.append(h)
        return out

    total, letters, labels = np.zeros(len(model.langs)), 0, []
    for k in range(0, len(text), language_id.WINDOW):
        window = text[k : k + language_id.WINDOW]
        for b, s, t in zip(window, states(0, window), states(1, window[::-1])[::-1], strict=True):
            logits = model.head @ np.concatenate([s, t]) + model.bias[:, 0]
            p = np.exp(logits - logits.max())
            labels.append(int(p.argmax()))
            if b >= 128 or chr(b).isalpha():
                total, letters = total + p / p.sum(), letters + 1
    return total, letters, labels


def test_labels_against_a_slow_loop(trained):
    model, d = trained
    texts = [(r["text"] or "")[:900].encode() for r in d.orderBy("doc_id").limit(12).collect()] + [b"", b"1 2", "é".encode() * 200, b"x" * 257]
    total, letters, labels = language_id.label(model, texts, side=5, positions=True)
    at = 0
    for k, text in enumerate(texts):
        t, n, slow = slow_label(model, text)
        assert np.allclose(total[k], t, atol=1e-3 * (n + 1)) and letters[k] == n
        assert np.mean(labels[at : at + len(text)] == np.array(slow)) > 0.99 if text else True
        at += len(text)


def test_language_columns(spark, trained):
    model, _ = trained
    d = docs(spark, (1, "the house and the garden"), (1, "the house and the garden"), (2, None)).withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit("y")).withColumn("_bytes", F.lit(1))
    for keep in (True, False):
        found = language_id.predict(d, model, keep_text=keep)
        assert ("text" in found.columns) == keep and [c.lower() for c in found.columns].count("score") == 1 and found.columns.count("lang_pred") == 1
        rows = found.select("doc_id", "lang_pred", "score", "_bytes").collect()
        assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == [(1, "en"), (1, "en"), (2, "und")] and rows[0]["score"] == rows[1]["score"]
    assert language_id.predict(d.limit(0), model).count() == 0


def test_language_edges(spark, trained):
    model, _ = trained
    long = "the and of tion her ing " * 20_000
    found = language_id.predict(docs(spark, (1, None), (2, ""), (3, "123 —!"), (4, long), (5, "the")), model, segments=True)
    got = {r["doc_id"]: r for r in found.collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "en" and 0 <= got[5]["score"] <= 1
    assert got[4]["lang_runs"][-1]["end"] == len(long)
    assert language_id.fit(docs(spark, (1, "a", None))) is None
    assert rows_of(language_id.predict(docs(spark, (1, "a")), None), "lang_pred") == [("und",)]


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    width, f = 3, np.float64
    table, rec = rng.normal(0, 0.3, (9, 256)), rng.normal(0, 0.3, (9, 3))
    table[:6] += 0.5
    x = rng.integers(0, 4, (5, 2)).astype(np.intp)
    goal = rng.normal(size=(5, width, 2))
    value = lambda t, r: float((language_id._forward(t.astype(np.float32), r.astype(np.float32), x)[0].astype(f) * goal).sum())
    _, saved = language_id._forward(table.astype(np.float32), rec.astype(np.float32), x, True)
    d_x, d_rec = language_id._backward(rec.astype(np.float32), saved, goal.astype(np.float32))
    for i, j in ((0, 0), (4, 1), (8, 2)):
        step = np.zeros_like(rec)
        step[i, j] = 1e-2
        assert abs((value(table, rec + step) - value(table, rec - step)) / 2e-2 - d_rec[i, j]) < 2e-2
    step = np.zeros_like(table)
    step[7, x[2, 0]] = 1e-2
    assert abs((value(table + step, rec) - value(table - step, rec)) / 2e-2 - sum(d_x[t, 7, b] for t in range(5) for b in range(2) if x[t, b] == x[2, 0])) < 2e-2


def test_training_windows_are_bounded(spark):
    """Repeated ids and rows do not widen the sample."""
    same = [(7, f"text number {k} of one id", "en") for k in range(3000)] + [(k, "always the same words", "de") for k in range(40) for _ in range(20)] + [(9, "one row", "fr")] * 2000
    found = language_id.training_windows(docs(spark, *same), "doc_id", "text", "lang", docs=50, each=3)
    assert found.groupby("lang").size().to_dict() == {"de": 120, "en": 150, "fr": 3}
    assert found.equals(language_id.training_windows(docs(spark, *same).repartition(5), "doc_id", "text", "lang", docs=50, each=3))


def test_equal_sha1_is_not_equal_content(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "a")], "page_id long, url string, html string")
    monkeypatch.setattr(F, "sha1", lambda c: F.lit("0" * 40))
    index = warc.write_archives(pages, _shared.new_folder(spark, "warc"))
    assert rows_of(index, "page_id", "record_type", "refers_to") == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 1)], key=repr)


def test_pack_and_mix_of_many_null_ids(spark):
    data = [(None, f"word {k} of a text") for k in range(2000)]
    d = docs(spark, *data)
    shards = packing.pieces(d, packing.n_words(F.col("text")), 64).select(F.pmod(F.xxhash64("_id", "piece", F.lit(11), "_t"), F.lit(40)).alias("s"))
    assert max(r["count"] for r in shards.groupBy("s").count().collect()) < 150
    rows = packing.pack(d, max_len=64, buckets=2, token_budget=50).collect()
    assert len(rows) == 2000 and len({(r["bucket"], r["batch"], r["row"]) for r in rows}) == 2000
    # of one place and id, all or none
    assert mixing.mix(d, {"source": F.col("source")}, {}, 0.5, 1, 3).count() == 0 and mixing.mix(d, {"source": F.col("source")}, {}, 1.0, 1, 3).count() == 2000


def test_water_filling_of_equal_children(spark):
    """Children of one ratio are one row before anything is ranked."""
    rows = [(0, k, 100, 1.0, 55_000.0) for k in range(1000)] + [(1, k, 100 + k % 2, 1.0, 30_000.0) for k in range(1000)]
    frame = spark.createDataFrame(rows, "g long, k long, cap long, weight double, given double")
    got = {(r["g"], r["k"]): r["budget"] for r in mixing.share(frame, ["g"]).collect()}
    assert len(got) == 2000 and all(np.isclose(v, 55 if g == 0 else 30) for (g, _), v in got.items())
