import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import language_id, line_dedup, mixing, packing
from test_operators import near_groups, rows_of, slow_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, from the first two hundred documents on and some planted rows."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = [(900_001, None, "en", "src1", 0), (900_002, "", "en", "src1", 0), (900_003, "12 34 !", None, None, 7)]
    nameless = d.filter("doc_id IN (7, 8)").withColumn("doc_id", F.lit(None).cast("long"))
    twice = d.filter("doc_id = 5").unionByName(nameless).unionByName(nameless.filter("text IS NOT NULL"))
    d = d.unionByName(spark.createDataFrame(more, d.schema)).unionByName(twice).withColumn("_deleted", F.lit("x")).withColumn("score", F.lit(0))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, d, SF).persist()
        out.append((d, after))
        d = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}


def test_language_stage(stages):
    before, after = stages[0]
    assert after.columns == corpus_pipeline.COLUMNS
    model = language_id.fit(before.filter(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    want = []
    for r in before.collect():
        total, letters, _ = language_id.label(model, [(r["text"] or "").encode()])
        if letters[0] and language_id.has_letter((r["text"] or "").encode()) and (total[0] / letters[0]).max() >= corpus_pipeline.LEAST_SCORE:
            want.append(r["doc_id"])
    got = [r["doc_id"] for r in after.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got.count(5) == 2 and not {900_001, 900_002, 900_003} & set(got)
    assert len(got) >= 0.98 * before.count()


def test_line_stage(stages):
    before, after = stages[1]
    data = texts(before)
    gone = slow_line_dedup(list(data.items()))
    want = {}
    for i, text in data.items():
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        if not gone[i] or kept.strip(" "):
            want[i] = kept
    assert texts(after) == want and any(gone.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_stage(stages):
    before, after = stages[2]
    groups, _ = near_groups(texts(before))
    # the repeated row stays once, and so does each without an id
    assert rows_of(after.filter("doc_id IS NOT NULL"), "doc_id") == sorted(((i,) for i, g in groups.items() if i == g), key=repr)
    assert before.filter("doc_id IS NULL").count() == 4 and after.filter("doc_id IS NULL").count() == 2


def test_mix_stage(stages):
    before, after = stages[3]
    size = lambda t: len((t or "").split())
    total = sum(size(t) for t in texts(before).values())
    taken = texts(after)
    assert set(taken) < set(texts(before)) and all(size(t) for t in taken.values())
    nameless = [size(r["text"]) for r in before.collect() if r["doc_id"] is None]
    total += sum(nameless)
    leaves = before.select(*[e.alias(n) for n, e in mixing.levels().items()]).distinct().count()
    most = max(size(t) for t in texts(before).values())
    most = max([most, *nameless])
    sizes = [size(r["text"]) for r in after.collect()]
    assert 0.8 * total - leaves * most <= sum(sizes) <= 0.8 * total + 1


def test_pack_stage(stages):
    before, after = stages[4]
    want = [(i, k, min(2048, len(t.split()) - 2048 * k)) for i, t in ((r["doc_id"], r["text"]) for r in before.collect()) for k in range(max(1, -(-len(t.split()) // 2048)))]
    assert rows_of(after, "doc_id", "piece", "n_tokens") == sorted(want, key=repr)
    bounds = packing.boundaries({n: sum(1 for *_, m in want if m == n) for _, _, n in want if n}, 8)
    assert all(r["pad_to"] == min(b for b in bounds if b >= r["n_tokens"]) for r in after.collect() if r["n_tokens"])


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and before * 0.95 < kept.count() <= before
    lines = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert 0 < lines.count() <= before and line_dedup.line_dedup(docs).filter(F.size("_deleted") > 0).count() > 0
    near = corpus_pipeline.dedup_near(spark, docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)), sf)
    assert near.filter("doc_id >= 1000000").count() == 0 and near.count() == near.select("doc_id").distinct().count()
    packed = corpus_pipeline.run(spark, sf)
    assert 0 < packed.select("doc_id").distinct().count() < before


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
