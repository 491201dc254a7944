import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import features as P
from codeloom.functions import sequences as Q
from codeloom.functions import vectors as V
from codeloom.operators import kmeans, metrics, residual
from codeloom.operators import sids as I
from codeloom.sources import tables as S
from codeloom.streaming import sids as T


def one(df, col):
    return [r[col] for r in df.collect()]


def arrays(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([(k, *[c[k] for c in cols.values()]) for k in range(n)], "id long, " + ", ".join(f"{c} array<long>" for c in cols))


def test_worked_sequence_cases(spark):
    df = arrays(spark, s=[[1, 2, 3, 4, 5], [1, 2]])
    assert one(df.select(Q.pad_or_trim("s", 3, -1).alias("x")), "x") == [[3, 4, 5], [1, 2, -1]]
    df = arrays(spark, s=[[0, 1, 2]], m=[[1, 1, 1]])
    assert one(df.select(Q.offset_tokens("s", 300, 3, "m").alias("x")), "x") == [[0, 301, 602]]
    df = arrays(spark, s=[[1, 2, 3, 4]])
    assert one(df.select(Q.insert_separator("s", 4, 9).alias("x")), "x") == [[1, 2, 3, 4, 9]]
    rows = Q.contiguous_subsequences(arrays(spark, s=[[1, 2, 3], [7]]), "s").select("start", "end", Q.window("s").alias("x"))
    assert one(rows.orderBy("end", "start"), "x") == [[1, 2], [1, 2, 3], [2, 3]]
    row = Q.next_k_split(arrays(spark, s=[[5, 6, 7, 8]]), "s", 2, 0, 1).first()
    assert (row["s"], row["label"], row["label_pos"]) == ([5, 6, 1, 0], [7, 8], 2)
    grid = arrays(spark, s=[[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    locs = spark.createDataFrame([(0, 1), (1, 2)], "id long, pos int")
    assert sorted(one(Q.gather_locations(grid, locs, "id", "s"), "value")) == [2, 6]


def test_errors(spark):
    with pytest.raises(Exception, match="fewer than 3"):
        Q.next_k_split(arrays(spark, s=[[5, 6]]), "s", 2, 0, 1).collect()
    with pytest.raises(ValueError):
        Q.last_k_mask(5, "n", 0)
    vec = spark.createDataFrame([(0, [1.0, 2.0]), (9, [1.0, 2.0])], "k long, v array<double>")
    with pytest.raises(ValueError):
        S.merge_keyed(vec, "k", "v", "k")
    with pytest.raises(ValueError):
        kmeans.init_buffer(vec, "k", "v", 10, 3)
    with pytest.raises(ValueError):
        V.sq_distances(np.zeros((1, 2)), np.zeros((1, 3)))
    sids = spark.createDataFrame([(0, [1, 2])], "item_id long, sid array<int>")
    with pytest.raises(ValueError):
        Q.to_sid_tokens(arrays(spark, s=[[0]]), sids, "id", "s", 3)
    with pytest.raises(Exception, match="no code for item"):
        Q.to_sid_tokens(arrays(spark, s=[[5]]), sids, "id", "s").collect()


def test_collision_digits_and_hot_tuple(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (2, [1, 2]), (3, [1, 2])]
    got = {r["item_id"]: r["digit"] for r in I.dedup_sids(spark.createDataFrame(rows, "item_id long, sid array<int>")).collect()}
    assert got == {0: 1, 1: 0, 2: 2, 3: 3}
    hot = spark.range(1000).select(F.col("id").alias("item_id"), F.array(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).cast("array<int>").alias("sid"))
    digits = I.dedup_sids(hot).filter("item_id % 2 = 0").orderBy("item_id")
    assert one(digits, "digit") == list(range(1, 501))


def test_metric_cases(spark):
    miss = spark.createDataFrame([(1, k, 1.0 - k / 10, False) for k in range(10)], "user_id long, pos int, score double, target boolean")
    hit = miss.withColumn("target", F.col("pos") == 2)
    assert one(metrics.ndcg(miss, 5), "ndcg_5") == [0.0] and one(metrics.recall(miss, 5), "recall_5") == [0.0]
    assert one(metrics.ndcg(hit, 5), "ndcg_5") == [0.5] and one(metrics.recall(hit, 5), "recall_5") == [1.0]
    assert metrics.evaluate(miss.limit(0)).first()["ndcg_5"] == 0.0


def points(spark, n=400, d=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)) + 4 * np.eye(d)[np.arange(n) % d]
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


def test_step_mirror_and_partitions(spark):
    x, df = points(spark)
    state = kmeans.Codebook(x[:5].copy(), np.array([3.0, 0, 1, 2, 0]))
    code = ((x[:, None] - state.centroids[None]) ** 2).sum(2).argmin(1)
    want = state.centroids.copy()
    for k in range(5):
        n = (code == k).sum()
        want[k] -= (want[k] - x[code == k].mean(0)) * n / (state.counts[k] + n)
    for parts in (1, 7):
        got = kmeans.minibatch_step(df.repartition(parts), "v", state)
        assert np.allclose(got.centroids, want) and np.allclose(got.counts, state.counts + np.bincount(code, minlength=5))


def test_fits(spark):
    x, df = points(spark)
    first = kmeans.init_kmeanspp(x, 6, 0)
    state, _ = kmeans.fit_kmeans(df, "id", "v", 6, 20)
    assert kmeans.inertia(df, "v", state.centroids) < kmeans.inertia(df, "v", first.centroids)
    books, history = residual.fit_rq(df, "id", "v", 2, 6, 8, normalize=False)
    assert len(books) == 2 and len(history) == 8
    first = kmeans.init_kmeanspp(kmeans.init_buffer(df, "id", "v", 3072, 6, 0), 6, 0).centroids
    code = ((x[:, None] - first[None]) ** 2).sum(2).argmin(1)
    want = sum(((first[c] - x[code == c].mean(0)) ** 2).sum() for c in set(code.tolist()))  # all counts are new: weights of 1
    assert np.isclose(history[0][2], want)
    rvq, losses = residual.fit_rvq(df, "id", "v", 1, 6, 12, lr=0.3, normalize=False)
    assert np.isclose(losses[0][2], 1.25 * ((x - first[code]) ** 2).sum()) and losses[-1][2] < losses[0][2]
    g = 2 * (np.bincount(code, minlength=6)[:, None] * first - np.array([x[code == c].sum(0) for c in range(6)])) / len(x)
    one, _ = residual.fit_rvq(df, "id", "v", 1, 6, 1, lr=0.3, normalize=False)
    assert np.allclose(one[0], first - 0.3 * g / (abs(g) + 1e-10))
    codes, total, first_r, last, error = residual.walk(x, books, normalize=False)
    assert np.allclose(error, (first_r**2).sum(1) + (last**2).sum(1))
    assert (last**2).sum() < (first_r**2).sum() < (x**2).sum() and np.allclose(total + last, x)
    w, _, errors = residual.fit_opq(df, "id", "v", 1, 6, 3, 4)
    assert np.allclose(w @ w.T, np.eye(6), atol=1e-8) and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False))
    assert kmeans.init_kmeanspp(np.ones((4, 2)), 3).centroids.shape == (3, 2)
    many = kmeans.init_kmeans_parallel(df, "id", "v", 6, seed=3).centroids
    rows = {tuple(v) for v in x.tolist()}
    assert len(many) == 6 and {tuple(v) for v in many.tolist()} <= rows
    assert np.allclose(many, kmeans.init_kmeans_parallel(df.repartition(5), "id", "v", 6, seed=3).centroids)
    even = kmeans.init_random(df, "id", "v", 6).centroids
    assert kmeans.inertia(df, "v", many) < 1.5 * kmeans.inertia(df, "v", even)


def test_streams(spark, tmp_path):
    x, df = points(spark, 60)
    df.write.parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.assign_stream(sdf, "id", "v", [x[:4], x[4:8]]).writeStream.format("memory").queryName("codes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    plain = residual.assign_rq(df, "id", "v", [x[:4], x[4:8]])
    assert sorted(map(str, spark.sql("SELECT id, sid FROM codes").collect())) == sorted(map(str, plain.select("id", "sid").collect()))
    start, state = kmeans.Codebook(x[:4].copy()), str(tmp_path / "state")
    for c in ("c2", "c3"):  # a new checkpoint begins anew beside the states of the old one
        q = T.fit_stream(sdf, "v", start, state, str(tmp_path / c))
        q.awaitTermination()
        got = T.read_state(spark, f"{state}/{q.id}", 0)
        assert np.allclose(got.centroids, kmeans.minibatch_step(df, "v", start).centroids)
        assert np.allclose(T.fit_batch(df, 0, "v", start, f"{state}/{q.id}").centroids, got.centroids)
    (tmp_path / "half" / "batch=0").mkdir(parents=True)
    assert T.read_state(spark, str(tmp_path / "half"), 0) is None


def test_stream_of_many_batches(spark, tmp_path):
    """Three batches, killed after the second has its state but is not yet committed, begun again; two states are kept."""
    x, df = points(spark, 90)
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start, state, checkpoint = kmeans.Codebook(x[:4].copy()), str(tmp_path / "state"), str(tmp_path / "check")
    steps = [start]
    for k in range(3):
        steps.append(kmeans.minibatch_step(df.filter(F.col("id") % 3 == k), "v", steps[-1]))
    kept, calls = T.fit_batch, []

    def dies(df, batch_id, *rest):
        calls.append(batch_id)
        out = kept(df, batch_id, *rest)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("killed")
        return out

    T.fit_batch = dies
    try:
        with pytest.raises(Exception, match="killed"):
            T.fit_stream(stream(), "v", start, state, checkpoint).awaitTermination()
        q = T.fit_stream(stream(), "v", start, state, checkpoint)
        q.awaitTermination()
    finally:
        T.fit_batch = kept
    assert calls == [0, 1, 1, 2]
    got = T.read_state(spark, f"{state}/{q.id}", 2)
    assert np.allclose(got.centroids, steps[3].centroids) and got.counts.sum() == 90
    assert sorted(p.name for p in (tmp_path / "state" / str(q.id)).iterdir() if p.is_dir()) == ["batch=1", "batch=2"]


def test_tokens_of_rows_that_share_a_key(spark):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id int")
    df = spark.createDataFrame([(1, "a b"), (1, "B x"), (1, "a b"), (None, "b"), (2, None), (3, "")], "id long, text string")
    want = sorted([(1, [2, 3, 0]), (1, [3, 1, 0]), (1, [2, 3, 0]), (None, [3, 0, 0]), (2, [0, 0, 0]), (3, [0, 0, 0])], key=repr)
    for most in (10, 1):  # a vocabulary that travels with the tasks, and one that is joined
        rows = P.tokenize_text(df, "id", "text", vocab, 3, most_tokens=most).collect()
        assert sorted(((r["id"], r["ids"]) for r in rows), key=repr) == want
        assert all(r["mask"] == [int(t != 0) for t in r["ids"]] for r in rows)
    twice = vocab.unionByName(vocab)
    with pytest.raises(Exception, match="two ids"):
        P.tokenize_text(df, "id", "text", twice, 3).collect()
    with pytest.raises(Exception, match="two ids"):
        P.tokenize_text(df, "id", "text", twice, 3, most_tokens=1).collect()


def test_beams_over_the_prefix_index(spark):
    """Against all tuples: with as many beams as tuples nothing is cut off."""
    from codeloom.operators import decode

    rng = np.random.default_rng(5)
    sids = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if (a + b + c) % 2]
    rows = [(u, list(s[:h]), c, float(rng.normal())) for u in range(4) for h in range(3) for s in {t[:h] for t in sids} for c in range(3)]
    logits = spark.createDataFrame(rows, "user_id long, prefix array<int>, code int, logit double")
    known = spark.createDataFrame([(k, list(s)) for k, s in enumerate(sids)], "item_id long, sid array<int>")
    index = {tuple(r) for r in decode.prefix_index(known, 3).select("depth", F.concat_ws("-", F.col("prefix").cast("array<string>")), "code").collect()}
    assert index == {(h, "-".join(map(str, s[:h])), s[h]) for s in sids for h in range(3)}
    weight = {(u, tuple(p), c): np.exp(x) for u, p, c, x in rows}
    for beams in (100, 2):
        got = {(r["user_id"], tuple(r["sid"])): (r["rank"], r["probability"]) for r in decode.beam_decode(logits, 3, beams, known).collect()}
        for u in range(4):
            held = {(): 1.0}
            for h in range(3):
                valid = {t[: h + 1] for t in sids}
                total = {p: sum(weight[u, p, c] for c in range(3) if (*p, c) in valid) for p in held}
                grown = {(*p, c): held[p] * weight[u, p, c] / total[p] for p in held for c in range(3) if (*p, c) in valid}
                held = dict(sorted(grown.items(), key=lambda x: (-round(x[1], 12), x[0]))[:beams])
            for rank, (s, p) in enumerate(sorted(held.items(), key=lambda x: (-round(x[1], 12), x[0])), 1):
                assert got[u, s][0] == rank and np.isclose(got[u, s][1], p)
        assert len(got) == 4 * min(beams, len(sids))


def test_limited_files(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "t"))
    assert S.read_table(spark, str(tmp_path / "t"), ["id"]).count() == 30
    some = S.read_table(spark, str(tmp_path / "t"), ["id"], "part-*", 2)
    assert some.inputFiles() == sorted(S.read_table(spark, str(tmp_path / "t")).inputFiles())[:2] and 0 < some.count() < 30


def test_mapping_and_sink(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": 2}')
    assert {r["category"]: r["index"] for r in S.load_mapping(spark, str(tmp_path / "m.json")).collect()} == {"a": 1, "b": 2}
    S.write_predictions(spark.range(25).select("id", F.lit(1).alias("v")).coalesce(1), str(tmp_path / "out"), "id", "v", 10)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3


def test_embedding_errors(spark):
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0])], "k long, v array<double>")
    with pytest.raises(ValueError, match="more than once"):
        S.load_embeddings(twice, "k", "v")
    with pytest.raises(ValueError, match="widths 1 to 2"):
        S.load_embeddings(spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], "k long, v array<double>"), "k", "v")


def test_category_lists_and_errors(spark):
    mapping = spark.createDataFrame([("a", 1), ("b", 2)], "category string, index int")
    df = spark.createDataFrame([(0, ["b", "x", "a", "b", None]), (1, []), (2, None)], "id long, c array<string>")
    assert {r["id"]: r["c"] for r in P.encode_category(df, "c", mapping, key="id").collect()} == {0: [2, 0, 1, 2, 0], 1: [], 2: None}
    with pytest.raises(ValueError, match="key"):
        P.encode_category(df, "c", mapping)
    with pytest.raises(Exception, match="two indexes of category a"):
        P.encode_category(df.select("id", F.lit("a").alias("c")), "c", mapping.unionByName(mapping.limit(1))).collect()


def test_windows_are_drawn_without_making_all(spark):
    n = 10_000
    df = spark.createDataFrame([(0, list(range(n))), (1, [5, 6, 7]), (2, [5])], "id long, s array<long>")
    rows = Q.draw_windows(df, "id", "s", 1, 64, 9)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = [(r["id"], r["start"], r["end"]) for r in rows.collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 2), (1, 0, 3), (1, 1, 3)] and not [x for x in got if x[0] == 2]
    mine = [x for x in got if x[0] == 0]
    assert 60 < len(mine) == len(set(mine)) <= 64 and all(0 <= a < b - 1 < n for _, a, b in mine)
    for k in (2, 3, 50, 1000):  # every number is a window of its own, in the order of ends, then starts
        pairs = [(a, b) for b in range(2, k + 1) for a in range(b - 1)]
        all_ = Q.draw_windows(spark.createDataFrame([(0, list(range(k)))], "id long, s array<long>"), "id", "s", 1, 10**6, 1)
        assert [(r["start"], r["end"]) for r in all_.collect()] == pairs
    out = Q.training_rows(df.filter("id < 2"), "id", "s", 1, 16, 1, -1, -2, 64, 9)
    assert all(len(r["s"]) == 16 and len(r["label"]) == 1 for r in out.collect())


def test_group_draws(spark):
    """Windows of a group's rows are numbered together, in the order of the rows' digests."""
    import hashlib

    sizes = {0: 10_000, 1: 3, 2: 1, 3: 0, 4: None, 5: 40, 6: 2, 7: 25, 8: 7, 9: 6}
    df = spark.createDataFrame([(k, None if n is None else list(range(n))) for k, n in sizes.items()], "id long, s array<long>")
    digest = lambda *x: hashlib.md5("-".join(map(str, x)).encode()).hexdigest()
    order = sorted(sizes, key=lambda k: digest(k, 9))
    want = set()
    for g in range(0, 10, 4):
        few = order[g : g + 4]
        counts = [(sizes[k] or 0) * ((sizes[k] or 0) - 1) // 2 for k in few]
        total = sum(counts)
        for i in range(min(total, 30)):
            t = i if total <= 30 else int(digest(g // 4, i, 9)[:15], 16) % total
            for k, n in zip(few, counts, strict=True):
                if t < n:
                    end = next(e for e in range(2, sizes[k] + 1) if e * (e - 1) // 2 > t)
                    want.add((g // 4, k, t - (end - 2) * (end - 1) // 2, end))
                    break
                t -= n
    for shards, parts in ((4096, 3), (2, 1)):
        got = Q.draw_group_windows(df.repartition(parts), "id", "s", 1, 4, 30, 9, shards).select("group", "id", "start", "end")
        assert "Generate explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert any(k == 0 for _, k, _, _ in want) and len({g for g, *_ in want}) == 3
    assert Q.draw_group_windows(df.limit(0), "id", "s", 1, 4, 30, 9).count() == 0


def test_sums_of_rows(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 7, 500).tolist()
    x = rng.normal(size=(500, 3))
    frame = spark.createDataFrame([(k, 1.0, v) for k, v in zip(keys, x.tolist(), strict=True)], "k long, n double, s array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 16, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r["k"]: (r["n"], r["s"]) for r in V.sum_rows(frame, "k").collect()}
        assert all(got[k][0] == keys.count(k) and np.allclose(got[k][1], x[np.array(keys) == k].sum(0)) for k in set(keys)) and len(got) == len(set(keys))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert V.sum_rows(frame.limit(0), "k").count() == 0


def test_nearest_with_equal_centroids():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(6, 5))
    c = np.concatenate([c, c[::-1], c + 1e-11])
    x = np.concatenate([rng.normal(size=(5000, 5)), c])
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (V.nearest(x, c) == want).all()


def test_cross_entropy_over_a_table_of_keys(spark):
    x, df = points(spark, 90, 4)
    keys = df.select("id", F.col("v").alias("vec"))
    asked = df.withColumn("label", (F.col("id") * 7) % 90)
    plain = V.full_softmax_ce(asked, "id", "v", "label", x).first()["ce"]
    for block in (20, None):
        assert np.isclose(V.full_softmax_ce(asked, "id", "v", "label", keys, block=block).first()["ce"], plain)
    x2, df2 = points(spark, 9000, 3)  # more keys than a task takes at a time
    logits = (x2 / np.linalg.norm(x2, axis=1)[:, None])[:50] @ (x2 / np.linalg.norm(x2, axis=1)[:, None]).T
    some = df2.filter("id < 50").withColumn("label", F.col("id") * 100)
    want = (np.log(np.exp(logits).sum(1)) - logits[np.arange(50), np.arange(50) * 100]).mean()
    assert np.isclose(V.full_softmax_ce(some, "id", "v", "label", df2.select("id", F.col("v").alias("vec"))).first()["ce"], want)
    with pytest.raises(ValueError, match="as a table"):
        V.full_softmax_ce(asked, "id", "v", "label", x, block=20)


def test_cross_entropy_shuffles_no_row_once_a_block(spark, monkeypatch):
    x, df = points(spark, 3000, 4)
    keys = df.select("id", F.col("v").alias("vec"))
    asked = df.withColumn("label", (F.col("id") * 7) % 3000)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    logits = u @ u.T
    want = (np.log(np.exp(logits).sum(1)) - logits[np.arange(3000), np.arange(3000) * 7 % 3000]).mean()

    def shuffled(block):
        store, sc = spark._jsc.sc().statusStore(), spark.sparkContext
        stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()))}
        before = stages()
        assert np.isclose(V.full_softmax_ce(asked, "id", "v", "label", keys, block=block).first()["ce"], want)
        spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return sum(n for k, n in stages().items() if k not in before)

    assert shuffled(30) < 30_000  # both sides once, and a row of each query and block of keys; a copy for each block of 30 keys and of 30 queries would be 600,000
    monkeypatch.setattr(V, "BLOCK_BYTES", 200 * 4 * 8)  # 15 blocks of each side
    assert 3000 * 15 <= shuffled(None) < 3000 * 18


def test_cross_entropy_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 16 * 3 * 8)  # several blocks of either side
    rng = np.random.default_rng(5)
    for scale, normalize in ((1.0, True), (1.0, False), (60.0, False)):  # dot products beyond the range of exponentials
        x, y = rng.normal(size=(70, 3)) * scale, rng.normal(size=(90, 3)) * scale
        ids, labels = [k // 2 for k in range(90)], [(k * 3) % 50 for k in range(70)]  # ids repeat; labels of 45 and more have no key
        asked = spark.createDataFrame([*[(f"q{k}", labels[k], v) for k, v in enumerate(x.tolist())], ("none", 1, None), ("hole", 1, [1.0, None, 2.0]), ("unlabelled", None, [1.0, 2.0, 3.0])], "id string, label long, v array<double>")
        keys = spark.createDataFrame([*[(i, v) for i, v in zip(ids, y.tolist(), strict=True)], (1, None), (2, [None, 1.0, 1.0]), (None, [0.5, 0.25, 1.0])], "id long, vec array<double>")
        unit = (lambda m: m / np.linalg.norm(m, axis=1)[:, None]) if normalize else (lambda m: m)
        logits = unit(x) @ unit(np.concatenate([y, [[0.5, 0.25, 1.0]]])).T
        most = logits.max(1)
        lse = most + np.log(np.exp(logits - most[:, None]).sum(1))
        want = np.mean([lse[k] - max(logits[k, 2 * labels[k]], logits[k, 2 * labels[k] + 1]) for k in range(70) if labels[k] < 45])
        for block in (7, None):
            assert np.isclose(V.full_softmax_ce(asked, "id", "v", "label", keys, normalize, block).first()["ce"], want, rtol=1e-9)
    assert V.full_softmax_ce(asked.limit(0), "id", "v", "label", keys).first()["ce"] is None
    assert V.full_softmax_ce(asked, "id", "v", "label", keys.limit(0)).first()["ce"] is None
    with pytest.raises(Exception, match="unequal widths"):
        V.full_softmax_ce(asked, "id", "v", "label", spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>")).first()
    with pytest.raises(Exception, match="unequal widths"):
        V.full_softmax_ce(asked, "id", "v", "label", spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0])], "id long, vec array<double>").coalesce(1)).first()


def test_retrieval_with_bounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(120, 5)), rng.normal(size=(900, 5))
    y *= np.exp(-(np.arange(900) % 30) / 5.0)[:, None]
    y[17] = y[400]  # a tie
    frame = lambda m, extra=(): spark.createDataFrame([*[(k, v) for k, v in enumerate(m.tolist())], *extra], "id long, vec array<double>")

    def plain(x, y, k):
        s = np.round(x @ y.T, 9)
        order = np.lexsort((np.broadcast_to(np.arange(len(y)), s.shape), -s), axis=1)[:, :k]
        return {(i, p + 1, int(j), s[i, j]) for i in range(len(x)) for p, j in enumerate(order[i])}

    monkeypatch.setattr(metrics, "KEYS_AT_ONCE", 16)
    for keys, block, share in ((y, 40, 0.5), (y, None, 0.5), (y, 7, 0.5), (y / np.linalg.norm(y, axis=1)[:, None], 100, None), (y[:3], 40, None), (y, 10_000, None)):
        found = metrics.retrieval(frame(x, [(999, None)]), frame(keys, [(9999, None)]), 7, block)
        got = found.found.collect()
        assert {(r["query_id"], r["pos"], r["key_id"], r["score"]) for r in got} == plain(x, keys, 7) and len(got) == 120 * min(7, len(keys))
        assert found.pairs == 120 * len(keys) and (share is None or found.met() < share * found.pairs)
    assert metrics.retrieve_all(frame(x), frame(y).limit(0), 3).count() == metrics.retrieve_all(frame(x).limit(0), frame(y), 3, 50).count() == 0
    negative = metrics.retrieve_all(frame(-np.abs(x)), frame(np.abs(y)), 3, 40)  # no score reaches 0: nothing is bounded away
    assert {(r["query_id"], r["pos"], r["key_id"], r["score"]) for r in negative.collect()} == plain(-np.abs(x), np.abs(y), 3)
    with pytest.raises(Exception, match="unequal widths"):
        metrics.retrieve_all(frame(x), frame(y[:, :4]), 3).collect()


def test_metrics_of_ones_own(spark):
    rows = [(u, p, 1.0 - p / 10, p in hits) for u, hits in ((1, {2, 4}), (2, {0}), (3, set())) for p in range(6)]
    cands = spark.createDataFrame(rows, "user_id long, pos int, score double, target boolean")
    first = metrics.evaluate(cands, [1, 5], {"mrr": metrics.MRR, "hits": metrics.Metric(lambda rank, hit: hit, lambda got, positives, k: got.cast("double"))}).first()
    assert np.isclose(first["mrr_5"], (1 / 3 + 1) / 3) and first["mrr_1"] == 1 / 3 and first["hits_5"] == 1 and first["users"] == 3


def test_distances_and_initialisers_of_ones_own(spark):
    x, df = points(spark, 200, 4)
    city = lambda a, b: np.abs(a[:, None] - b[None]).sum(2)
    book = x[:5] + 0.3
    got = {r["id"]: r["code"] for r in V.assign(df, "id", "v", book, city).collect()}
    assert [got[k] for k in range(200)] == city(x, book).argmin(1).tolist()
    cosine = 1 - (x / np.linalg.norm(x, axis=1)[:, None]) @ (book / np.linalg.norm(book, axis=1)[:, None]).T
    got = {r["id"]: r["sid"] for r in residual.assign_rq(df, "id", "v", [book], normalize=False, distances=V.cosine_distances).collect()}
    assert [got[k][0] for k in range(200)] == cosine.argmin(1).tolist()
    assert V.nearest(np.zeros((1, 4)), book, V.cosine_distances).tolist() == [0]
    for init in (kmeans.init_random, kmeans.init_kmeans_parallel, kmeans.from_fit(3), kmeans.from_buffer(50)):
        books, history = residual.fit_rq(df, "id", "v", 2, 4, 4, normalize=False, init=init, distances=city)
        assert [b.shape for b in books] == [(4, 4)] * 2 and len(history) == 4
    state, _ = kmeans.fit_kmeans(df, "id", "v", 4, 8, init=lambda df, key, col, k, seed, distances: kmeans.Codebook(x[:k].copy()), distances=city)
    assert kmeans.inertia(df, "v", state.centroids, city) < kmeans.inertia(df, "v", x[:4], city)


def test_residuals_of_all_layers(spark):
    x, df = points(spark, 50, 3)
    books = [x[:4], x[4:8] / 2, x[8:12] / 3]
    out = residual.assign_rq(df.unionByName(spark.createDataFrame([(99, None), (98, [1.0, None, 2.0])], df.schema)), "id", "v", books, normalize=False, track=True)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 52 and all(got[k]["sid"] is got[k]["residuals"] is None for k in (98, 99))
    for k in range(50):
        r = x[k]
        for book, seen in zip(books, got[k]["residuals"], strict=True):
            r = r - book[((r - book) ** 2).sum(1).argmin()]
            assert np.allclose(r, seen)


def test_widths_and_null_vectors(spark):
    uneven = spark.createDataFrame([(0, [1.0, 2.0], [1.0]), (1, [1.0], [2.0])], "id long, x array<double>, y array<double>")
    for made in (V.weighted_sse, V.beta_loss, V.mse):
        with pytest.raises(Exception, match="unequal widths"):
            made(uneven, "x", "y").collect()
    with pytest.raises(Exception, match="unequal widths"):
        uneven.select(V.squared_distance("x", "y")).collect()
    some = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 4.0]), (1, None, [2.0, 2.0]), (2, [1.0, 1.0], None)], "id long, x array<double>, y array<double>")
    assert V.mse(some, "x", "y").first()["mse"] == 2.0 and V.weighted_sse(some, "x", "y").first()["sse"] == 4.0
    got = {r["id"]: r["code"] for r in V.assign(some, "id", "x", np.array([[1.0, 1.0], [1.0, 3.0]])).collect()}
    assert got == {0: 0, 1: None, 2: 0}
    none = V.assign(some.filter("id = 1"), "id", "x", np.eye(2)).first()
    assert none["code"] is None and none["residual"] is None
    n, s, _ = kmeans.code_sums(some, "x", np.eye(2))
    assert n.tolist() == [1, 1]
    z = {r["id"]: r["z"] for r in V.standardize(some, "id", "x").collect()}
    assert z[1] is None and np.isclose(z[0][1], 1.0, atol=1e-3)


def test_moments_are_merged(spark):
    x = np.random.default_rng(3).normal(size=(700, 3)) + 1e6
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, v array<double>")
    for parts in (1, 50):
        r = V.moments(df.repartition(parts), "v").first()
        assert r["n"] == 700 and np.allclose(r["mean"], x.mean(0)) and np.allclose(np.array(r["m2"]) / 700, x.var(0), rtol=1e-6)
    assert V.moments(df.limit(0), "v").count() == 0 and V.standardize(df.limit(0), "id", "v").count() == 0
    plan = V.standardize(df, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_blocked_sums_of_a_rotation(spark):
    x, df = points(spark, 300, 20)
    w = V.to_orthogonal(np.random.default_rng(1).normal(size=(20, 20)))
    books = [x[:6] @ w.T]
    y = residual.walk(x @ w.T, books, normalize=False)[1]
    for width, tasks in ((256, 64), (6, 2), (20, 1)):
        m, error = residual.cross_sums(df.repartition(7), "v", w, books, width, tasks)
        assert np.allclose(m, x.T @ y) and np.isclose(error, ((x @ w.T - y) ** 2).sum())


def test_draws_are_even():
    u = residual.uniform(np.array([0, 1, -5, 2**40, 2**40 + 1]), 20_000, 3)
    assert len(np.unique(u)) > 99_000 and ((0 < u) & (u < 1)).all() and abs(u.mean() - 0.5) < 0.01
    assert (np.abs(np.corrcoef(u) - np.eye(5)) < 0.05).all() and not np.allclose(u, residual.uniform(np.array([0, 1, -5, 2**40, 2**40 + 1]), 20_000, 4))
