"""Queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import sequences as Q
from ..functions import vectors as V
from ..operators import decode, kmeans, metrics, residual
from ..operators import sids as I
from ..sources import tables as S
from ..sources.tables import shared_folder
from ..streaming import sids as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ---- the driver's tables as items, histories, code tables

E_SQL = "e AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SEQ_SQL = "s AS (SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
SID_SQL = "i AS (SELECT vec_id AS item_id, [label::INT, (vec_id % 4)::INT] AS sid FROM embeddings)"
TOK_SQL = f"{SEQ_SQL}, {SID_SQL}, x AS (SELECT user_id, unnest(seq) AS item_id, unnest(range(len(seq))) AS pos FROM s), t AS (SELECT user_id, flatten(list([sid[1]::BIGINT, sid[2]::BIGINT] ORDER BY pos)) AS tok FROM x JOIN i USING (item_id) GROUP BY user_id)"
JOIN = "array_to_string({}, '-')"


def items(spark, d, check=False):
    """The embeddings; ``load_embeddings`` below is the query that checks them."""
    return S.load_embeddings(S.read_table(spark, f"{d}/embeddings.parquet", ["vec_id", "embedding"]), "vec_id", "embedding", check)


def sequences(spark, d):
    rows = S.read_table(spark, f"{d}/events.parquet", ["user_id", "ts", "event_id", "props"])
    event = F.struct("ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("item"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(event)).alias("e")).select("user_id", F.col("e.item").alias("seq"))


def plain_sids(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.array(F.col("label").cast("int"), (F.col("vec_id") % 4).cast("int")).alias("sid"))


def tokens(spark, d):
    return Q.to_sid_tokens(sequences(spark, d), plain_sids(spark, d), "user_id", "seq").withColumn("tokens", F.col("tokens").cast("array<long>"))


def fixed_codebooks(spark, d, layers=2, k=16):
    """A codebook is a fixed range of vectors, scaled by half for each layer: no training."""
    rows = items(spark, d).filter(F.col("item_id") < layers * k).orderBy("item_id").collect()  # layers * k rows
    m = np.array([r["embedding"] for r in rows], np.float64)
    return [m[h * k : (h + 1) * k] * 0.5**h for h in range(layers)]


def joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), "-")


UNIT = "list_transform({x}, lambda a: a / greatest(sqrt(list_inner_product({x}, {x})), 1e-12))"


def _codes_sql(residual_: bool) -> str:
    r2 = "list_transform(list_zip(v, q1), lambda z: z[1] - z[2])" if residual_ else "v"
    minus = "list_transform(list_zip(r1, q2), lambda z: z[1] - z[2])" if residual_ else "v"
    return f"""{E_SQL},
c AS (SELECT item_id // 16 AS layer, item_id % 16 AS code, list_transform(v, lambda a: a * power(0.5, item_id // 16)) AS c FROM e WHERE item_id < 32),
u1 AS (SELECT item_id, v, {UNIT.format(x="v")} AS u FROM e),
a1 AS (SELECT item_id, any_value(v) AS v, arg_min(code, row(list_distance(u, c), code)) AS c1 FROM u1, c WHERE layer = 0 GROUP BY item_id),
b1 AS (SELECT item_id, v, c1, c AS q1 FROM a1 JOIN c ON layer = 0 AND code = c1),
r1 AS (SELECT item_id, v, c1, {r2} AS r1 FROM b1),
u2 AS (SELECT *, {UNIT.format(x="r1")} AS u FROM r1),
a2 AS (SELECT item_id, any_value(v) AS v, any_value(r1) AS r1, any_value(c1) AS c1, arg_min(code, row(list_distance(u, c), code)) AS c2 FROM u2, c WHERE layer = 1 GROUP BY item_id),
q AS (SELECT item_id, v, r1, c1, c2, r2 FROM (SELECT item_id, v, r1, c1, c2, c AS q2, {minus} AS r2 FROM a2 JOIN c ON layer = 1 AND code = c2))"""


@query(f"WITH {_codes_sql(True)} SELECT item_id, c1 || '-' || c2 AS sid, CASE WHEN count(*) OVER (PARTITION BY c1, c2) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY c1, c2 ORDER BY item_id) END AS digit FROM q")
def w1_sid_table(spark, d):
    sids = residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d)).select("item_id", "sid")
    return I.dedup_sids(sids).select("item_id", joined("sid").alias("sid"), F.col("digit").cast("long").alias("digit"))


@query(f"WITH {_codes_sql(True)} SELECT item_id, c1 || '-' || c2 AS sid, round(sqrt(list_inner_product(r2, r2)), 6) AS left_over FROM q")
def assign_rq(spark, d):
    out = residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d))
    return out.select("item_id", joined("sid").alias("sid"), F.round(F.sqrt(V.dot("last_residual", "last_residual")), 6).alias("left_over"))


@query(f"WITH {_codes_sql(True)} SELECT item_id, unnest([0, 1]) AS layer, unnest([round(list_sum(r1), 6), round(list_sum(r2), 6)]) AS total, unnest([round(sqrt(list_inner_product(r1, r1)), 6), round(sqrt(list_inner_product(r2, r2)), 6)]) AS norm FROM q")
def assign_rq_residuals(spark, d):
    """The residuals after each layer."""
    out = residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d), track=True)
    each = out.select("item_id", F.posexplode("residuals").alias("layer", "r"))
    return each.select("item_id", "layer", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.sqrt(V.dot("r", "r")), 6).alias("norm"))


@query(f"WITH {_codes_sql(True)}, l1 AS (SELECT u1.item_id, list_distance(u, c) ** 2 AS e FROM u1 JOIN a1 USING (item_id) JOIN c ON layer = 0 AND code = c1), l2 AS (SELECT u2.item_id, list_distance(u, c) ** 2 AS e FROM u2 JOIN q ON q.item_id = u2.item_id JOIN c ON layer = 1 AND code = c2) SELECT round(1.25 * (SELECT sum(e) FROM l1) + 1.25 * (SELECT sum(e) FROM l2), 6) AS loss")
def assignment_loss(spark, d):
    out = residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d))
    return residual.assignment_loss(out).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_codes_sql(False)} SELECT item_id, c1 || '-' || c2 AS sid FROM q")
def assign_mlq(spark, d):
    return residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d), residual=False).select("item_id", joined("sid").alias("sid"))


_STATS = "sqrt(sum(list_inner_product({a}, {a})) / sum(list_inner_product(v, v)))"


@query(f"""WITH {_codes_sql(True)}, l AS (SELECT 0 AS layer, c1 AS code, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 1, c2, count(*) FROM q GROUP BY 2)
SELECT 'usage' AS metric, layer, round(count(*) / 16.0, 6) AS value FROM l GROUP BY layer
UNION ALL SELECT 'entropy', layer, round(-sum(p * ln(p)), 6) FROM (SELECT layer, n / sum(n) OVER (PARTITION BY layer) AS p FROM l) GROUP BY layer
UNION ALL SELECT 'distinct', -1, round(count(DISTINCT c1 * 100 + c2) / count(*), 6) FROM q
UNION ALL SELECT 'mse', -1, round(sum(list_inner_product(r2, r2)) / sum(len(v)), 6) FROM q
UNION ALL SELECT 'first_share', -1, round({_STATS.format(a="r1")}, 6) FROM q
UNION ALL SELECT 'last_share', -1, round({_STATS.format(a="r2")}, 6) FROM q
UNION ALL SELECT CASE layer WHEN 0 THEN 'first_codebook_norm' ELSE 'last_codebook_norm' END, -1, round(sqrt(sum(list_inner_product(c, c))), 6) FROM c GROUP BY layer""")
def sid_stats(spark, d):
    books = fixed_codebooks(spark, d)
    assigned = residual.assign_rq(items(spark, d), "item_id", "embedding", books)
    return residual.sid_stats(assigned, books).withColumn("value", F.round("value", 6))


# ---- sources and sinks


@query("SELECT doc_id, lang FROM documents")
def read_table(spark, d):
    return S.read_table(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query(f"WITH {E_SQL}, n AS (SELECT count(*) AS n FROM e) SELECT r.range AS position, round(coalesce(list_sum(e.v), 0), 6) AS total FROM n, range(n.n) r LEFT JOIN e ON e.item_id = r.range AND e.item_id % 3 != 0")
def merge_keyed(spark, d):
    rows = items(spark, d).withColumn("key", F.when(F.col("item_id") % 3 == 0, F.greatest(F.col("item_id") - 2, F.lit(1)) ).otherwise(F.col("item_id")))
    # keys divisible by 3 are missing; their rows come before the last row of another key and lose
    merged = S.merge_keyed(rows.withColumn("o", (F.col("key") == F.col("item_id")).cast("int")), "key", "embedding", "o")
    return merged.select("position", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-3'), doc_id) AS place FROM documents")
def shuffle_rows(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return S.shuffle_places(rows, "doc_id", 3)


@query("SELECT DISTINCT lang AS category, dense_rank() OVER (ORDER BY lang) AS index FROM documents WHERE lang IS NOT NULL")
def load_mapping(spark, d):
    """The languages' numbers, written as a JSON object and read back."""
    langs = S.read_table(spark, f"{d}/documents.parquet", ["lang"]).filter("lang IS NOT NULL").groupBy("lang").count()
    numbered = F.map_from_entries(F.transform(F.array_sort(F.collect_list("lang")), lambda x, i: F.struct(x.alias("key"), (i + 1).alias("value"))))  # an entry per language
    folder = f"{shared_folder(spark)}/mapping-{uuid.uuid4().hex}"
    langs.agg(F.to_json(numbered).alias("value")).write.text(folder)
    return S.load_mapping(spark, folder).select("category", F.col("index").cast("long").alias("index"))


@query("SELECT doc_id AS id, lang AS value FROM documents")
def write_predictions(spark, d):
    """Predictions written in bounded files and read back."""
    folder = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    S.write_predictions(S.read_table(spark, f"{d}/documents.parquet", ["doc_id", "lang"]), folder, "doc_id", "lang", 5_000)
    return spark.read.parquet(folder).select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))


@query(f"WITH {E_SQL} SELECT item_id, len(v)::BIGINT AS width FROM e")
def load_embeddings(spark, d):
    return items(spark, d, check=True).select("item_id", F.size("embedding").cast("long").alias("width"))


# ---- features


@query("SELECT doc_id AS id, lang AS language FROM documents")
def map_features(spark, d):
    return P.map_features(spark.read.parquet(f"{d}/documents.parquet"), {"doc_id": "id", "lang": "language", "absent": "x"})


@query("SELECT doc_id, lang FROM documents")
def select_features(spark, d):
    return P.select_features(spark.read.parquet(f"{d}/documents.parquet"), ["lang"], keep=["doc_id"])


@query("SELECT event_id, trunc(value)::BIGINT AS value FROM events")
def cast_features(spark, d):
    out = P.cast_features(spark.read.parquet(f"{d}/events.parquet").select("event_id", "value"), {}, only=["value"])
    return out.select("event_id", F.col("value")[0].alias("value"))


@query("SELECT doc_id, lang FROM documents")
def decode_features(spark, d):
    return P.decode_features(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("lang", "UTF-8").alias("lang")), ["lang"])


@query(f"WITH {SEQ_SQL} SELECT user_id, len(seq)::BIGINT AS n FROM s WHERE len(seq) >= 66")
def filter_min_length(spark, d):
    return P.filter_min_length(sequences(spark, d), 66, ["seq"]).select("user_id", F.size("seq").cast("long").alias("n"))


@query(f"WITH {SEQ_SQL} SELECT user_id, len(list_filter(seq, lambda x: x < 1))::BIGINT AS n FROM s WHERE len(list_filter(seq, lambda x: x < 1)) > 0")
def filter_non_empty(spark, d):
    few = sequences(spark, d).withColumn("seq", F.filter("seq", lambda x: x < 1))
    return P.filter_non_empty(few, ["seq"]).select("user_id", F.size("seq").cast("long").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS lang FROM documents")
def encode_category(spark, d):
    mapping = spark.createDataFrame([("en", 1), ("fr", 2)], "category string, index int")
    return P.encode_category(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "lang", mapping)


@query(f"WITH {SEQ_SQL} SELECT user_id, array_to_string(list_transform(seq, lambda x: CASE x WHEN 1 THEN 11 WHEN 7 THEN 17 ELSE 0 END), '-') AS out FROM s")
def encode_category_list(spark, d):
    mapping = spark.createDataFrame([(1, 11), (7, 17)], "category long, index int")
    return P.encode_category(sequences(spark, d), "seq", mapping, key="user_id").select("user_id", joined("seq").alias("out"))


@query(f"WITH {SEQ_SQL} SELECT user_id, len(seq)::BIGINT AS n FROM s WHERE len(seq) >= 60 AND list_contains(seq, 7)")
def pipeline_of_rows(spark, d):
    steps = [lambda x: P.filter_min_length(x, 60, ["seq"]), lambda x: x.filter(F.array_contains("seq", 7))]
    return P.pipeline(sequences(spark, d), steps).select("user_id", F.size("seq").cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:128] AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i > len(w) THEN 0 ELSE CASE w[i] WHEN 'the' THEN 2 WHEN 'and' THEN 3 WHEN 'de' THEN 4 WHEN 'der' THEN 5 ELSE 1 END END), '-') AS ids, least(len(w), 128)::BIGINT AS n FROM t""")
def tokenize_text(spark, d):
    vocab = spark.createDataFrame([("the", 2), ("and", 3), ("de", 4), ("der", 5)], "token string, id int")
    out = P.tokenize_text(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", vocab)
    return out.select("doc_id", joined("ids").alias("ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


# ---- sequences


def seq_query(sql_expr: str, col, source=sequences, base=SEQ_SQL, table="s"):
    return (f"WITH {base} SELECT user_id, array_to_string({sql_expr}, '-') AS out FROM {table}", lambda spark, d: source(spark, d).select("user_id", joined(col()).alias("out")))


_PAD = "list_concat({0}, list_transform(range(greatest(0, {n} - len({0}))), lambda x: -1))"
_SEPARATED = "flatten(list_transform(range(len(m) // 2), lambda k: [m[2 * k + 1], m[2 * k + 2], m[2 * k + 2]]))"
_SEQ = {
    "insert_mask": (
        f"WITH {TOK_SQL}, k AS (SELECT user_id, list_transform(tok, lambda x: (x % 3 != 0)::INT) AS m FROM t) SELECT user_id, array_to_string({_SEPARATED}, '-') AS out FROM k",
        lambda spark, d: tokens(spark, d).withColumn("m", F.transform("tokens", lambda x: (x % 3 != 0).cast("int"))).select("user_id", joined(Q.insert_mask("m", 2)).alias("out")),
    ),
    "to_sid_tokens": seq_query("tok", lambda: F.col("tokens"), tokens, TOK_SQL, "t"),
    "trim": seq_query("seq[-40:]", lambda: Q.trim("seq", 40)),
    "trim_right": seq_query("seq[1:40]", lambda: Q.trim("seq", 40, left=False)),
    "drop_token": seq_query("list_filter(seq, lambda x: x != 7)", lambda: Q.drop_token("seq", 7)),
    "pad_or_trim": seq_query(_PAD.format("seq[-70:]", n=70), lambda: Q.pad_or_trim("seq", 70, -1)),
    "attention_mask": seq_query("list_transform(seq, lambda x: (x != 7)::INT)", lambda: Q.attention_mask("seq", 7)),
    "last_k_mask": seq_query("list_transform(range(100), lambda i: CASE WHEN i BETWEEN greatest(len(seq) - 5, 0) AND len(seq) - 1 THEN 'true' ELSE 'false' END)", lambda: Q.last_k_mask(100, F.size("seq") - 1, 5)),
    "offset_tokens": seq_query("list_transform(range(len(tok)), lambda k: tok[k + 1] + (k % 2) * 10)", lambda: Q.offset_tokens("tokens", 10, 2, F.transform("tokens", lambda x: F.lit(1))), tokens, TOK_SQL, "t"),
    "insert_separator": seq_query("flatten(list_transform(range(len(tok) // 2), lambda k: [tok[2 * k + 1], tok[2 * k + 2], 99]))", lambda: Q.insert_separator("tokens", 2, 99), tokens, TOK_SQL, "t"),
    "inference_rows": (
        f"WITH {SEQ_SQL}, f AS (SELECT user_id, list_filter(seq, lambda x: x != 7) AS q FROM s) SELECT user_id, array_to_string({_PAD.format('q[-70:]', n=70)}, '-') AS out, least(len(q), 70)::BIGINT AS n FROM f",
        lambda spark, d: Q.inference_rows(sequences(spark, d), "user_id", "seq", 70, -1, 7).select("user_id", joined("seq").alias("out"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n")),
    ),
}
for _name, (_sql, _fn) in _SEQ.items():
    QUERIES[_name], ORACLES[_name] = _fn, _sql


@query(f"WITH {E_SQL}, {SEQ_SQL}, x AS (SELECT user_id, seq[-1] AS item_id FROM s) SELECT user_id, item_id, round(list_sum(v), 6) AS total FROM x JOIN e USING (item_id)")
def attach_embedding(spark, d):
    last = sequences(spark, d).select("user_id", F.element_at("seq", -1).alias("item_id"))
    return Q.attach_embedding(last, items(spark, d), "item_id", "v").select("user_id", "item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


_WIN = f"{SEQ_SQL}, w AS (SELECT user_id, seq, unnest(range(2, len(seq) + 1)) AS hi FROM s), v AS (SELECT user_id, seq, hi, unnest(range(0, hi - 1)) AS lo FROM w)"


@query(f"WITH {_WIN} SELECT user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(seq[lo + 1:hi], '-') AS out FROM v")
def contiguous_subsequences(spark, d):
    found = Q.contiguous_subsequences(sequences(spark, d), "seq")
    return found.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined(Q.window("seq")).alias("out"))


@query(f"WITH {_WIN} SELECT user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\" FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '-' || lo || '-' || hi || '-5'), user_id, lo, hi) <= 20")
def sample_augmented(spark, d):
    spans = Q.sample_augmented(Q.contiguous_subsequences(sequences(spark, d).select("user_id", "seq"), "seq").select("user_id", "start", "end"), ["user_id"], 20, 5, ["user_id", "start", "end"])
    return spans.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_TOKEN_WIN = f"{TOK_SQL}, w AS (SELECT user_id, tok, unnest(range(2, len(tok) // 2 + 1)) AS hi FROM t), v AS (SELECT user_id, tok, hi, unnest(range(0, hi - 1)) AS lo FROM w)"


@query(f"WITH {_TOKEN_WIN} SELECT user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(tok[2 * lo + 1:2 * hi], '-') AS out FROM v")
def contiguous_subsequences_whole(spark, d):
    """Windows of whole items over histories of code digits."""
    found = Q.contiguous_subsequences(tokens(spark, d), "tokens", 2)
    return found.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined(Q.window("tokens", 2)).alias("out"))


def _group_draws(source: str, items: str, size: int, most: int, seed: int) -> str:
    """Windows (grp, lo, hi) of ``size`` users of ``source`` together, in the order of their digests: all, or ``most`` draws by digest, repeats left out."""
    return f"""h0 AS (SELECT *, {items} AS k, {items} * ({items} - 1) // 2 AS n FROM {source}), h1 AS (SELECT *, (row_number() OVER (ORDER BY md5(user_id || '-{seed}'), user_id) - 1) // {size} AS grp FROM h0),
h2 AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY md5(user_id || '-{seed}'), user_id ROWS UNBOUNDED PRECEDING)::BIGINT - n AS first, (sum(n) OVER (PARTITION BY grp))::BIGINT AS total FROM h1),
h3 AS (SELECT grp, total, unnest(range(least(total, {most}))) AS i FROM (SELECT DISTINCT grp, total FROM h2)),
h4 AS (SELECT DISTINCT grp, CASE WHEN total <= {most} THEN i ELSE ('0x' || substr(md5(grp || '-' || i || '-{seed}'), 1, 15))::BIGINT % total END AS t FROM h3),
h5 AS (SELECT h2.*, t - first AS t FROM h4 JOIN h2 ON h4.grp = h2.grp AND t >= first AND t < first + n),
h6 AS (SELECT *, 1 + floor((1 + sqrt(8.0 * t + 1)) / 2)::BIGINT + unnest([-1, 0, 1]) AS hi FROM h5), v AS (SELECT *, t - (hi - 2) * (hi - 1) // 2 AS lo FROM h6 WHERE t >= (hi - 2) * (hi - 1) // 2 AND t < (hi - 1) * hi // 2)"""


@query(f"WITH {SEQ_SQL}, {_group_draws('s', 'len(seq)', 32, 512, 5)} SELECT grp AS \"group\", user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(seq[lo + 1:hi], '-') AS out FROM v")
def sample_augmented_whole(spark, d):
    """Windows of whole histories, drawn from 32 users together."""
    found = Q.draw_group_windows(sequences(spark, d), "user_id", "seq", 1, 32, 512, 5)
    return found.select("group", "user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined(Q.window("seq")).alias("out"))


_WORDS = "s AS (SELECT doc_id AS user_id, string_split(text, ' ') AS seq FROM documents)"


@query(f"WITH {_WORDS}, {_group_draws('s', 'len(seq)', 32, 512, 5)} SELECT grp AS \"group\", user_id AS doc_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", md5(array_to_string(seq[lo + 1:hi], ' ')) AS digest FROM v")
def sample_augmented_documents(spark, d):
    """Windows of words, drawn from 32 documents together: up to 2e8 windows of one text are addressed, none made that is not kept."""
    rows = S.read_table(spark, f"{d}/documents.parquet", ["doc_id", "text"]).select("doc_id", F.split("text", " ").alias("seq"))
    found = Q.draw_group_windows(rows, "doc_id", "seq", 1, 32, 512, 5)
    return found.select("group", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.array_join(Q.window("seq"), " ")).alias("digest"))


def _draws(source: str, items: str, most: int, seed: int) -> str:
    """Windows (lo, hi) of each user of ``source``: all, or ``most`` draws by digest, repeats left out."""
    return f"""g0 AS (SELECT *, {items} AS k, {items} * ({items} - 1) // 2 AS n FROM {source}), g1 AS (SELECT *, unnest(range(least(n, {most}))) AS i FROM g0),
g2 AS (SELECT DISTINCT * EXCLUDE (i), CASE WHEN n <= {most} THEN i ELSE ('0x' || substr(md5(user_id || '-' || i || '-{seed}'), 1, 15))::BIGINT % n END AS t FROM g1),
g3 AS (SELECT *, unnest(range(2, k + 1)) AS hi FROM g2), v AS (SELECT *, t - (hi - 2) * (hi - 1) // 2 AS lo FROM g3 WHERE t >= (hi - 2) * (hi - 1) // 2 AND t < (hi - 1) * hi // 2)"""


@query(f"WITH {SEQ_SQL}, {_draws('s', 'len(seq)', 200, 6)} SELECT user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(seq[lo + 1:hi], '-') AS out FROM v")
def draw_windows(spark, d):
    found = Q.draw_windows(sequences(spark, d), "user_id", "seq", 1, 200, 6)
    return found.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined(Q.window("seq")).alias("out"))


@query(f"WITH {SEQ_SQL}, p AS (SELECT user_id, {_PAD.format('seq[-60:]', n=60)} AS q, least(len(seq), 60) AS n FROM s) SELECT user_id, array_to_string(list_concat(q[1:n - 2], [-2], list_transform(range(60 - n + 1), lambda x: -1)), '-') AS seq, array_to_string(q[n - 1:n], '-') AS label, (n - 2)::BIGINT AS label_pos FROM p")
def next_k_split(spark, d):
    rows = sequences(spark, d).withColumn("seq", Q.pad_or_trim("seq", 60, -1))
    return Q.next_k_split(rows, "seq", 2, -1, -2).select("user_id", joined("seq").alias("seq"), joined("label").alias("label"), F.col("label_pos").cast("long").alias("label_pos"))


@query(f"WITH {SEQ_SQL}, x AS (SELECT user_id, unnest(seq) AS token, unnest(range(len(seq))) AS pos FROM s) SELECT user_id, pos, token FROM x WHERE token != 7")
def token_labels(spark, d):
    return Q.token_labels(sequences(spark, d), "user_id", "seq", 7).select("user_id", F.col("pos").cast("long").alias("pos"), "token")


@query(f"WITH {SEQ_SQL} SELECT user_id, (user_id % 5)::INT AS pos, seq[user_id % 5 + 1] AS value FROM s")
def gather_locations(spark, d):
    seqs = sequences(spark, d)
    locs = seqs.select("user_id", (F.col("user_id") % 5).cast("int").alias("pos"))
    return Q.gather_locations(seqs, locs, "user_id", "seq").select("user_id", "pos", "value")


@query("SELECT DISTINCT user_id, (user_id % 8)::BIGINT AS bin FROM events")
def user_bin(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", Q.user_bin("user_id", 8).cast("long").alias("bin")).distinct()


_TRAIN = f"{TOK_SQL}, {_draws('t', 'len(tok) // 2', 64, 9)}, c AS (SELECT user_id, lo, hi, tok[2 * lo + 1:2 * hi][-16:] AS q FROM v)"


@query(f"WITH {_TRAIN} SELECT user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(list_concat(q[1:len(q) - 2], list_transform(range(16 - len(q) + 2), lambda x: -1)), '-') AS seq, array_to_string(q[-2:], '-') AS label, (len(q) - 2)::BIGINT AS n FROM c")
def training_rows(spark, d):
    out = Q.training_rows(tokens(spark, d), "user_id", "tokens", 2, 16, 2, -1, -1, 64, 9)
    return out.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined("tokens").alias("seq"), joined("label").alias("label"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


_TRAIN_GROUPS = f"{TOK_SQL}, {_group_draws('t', 'len(tok) // 2', 32, 512, 9)}, c AS (SELECT grp, user_id, lo, hi, tok[2 * lo + 1:2 * hi][-16:] AS q FROM v)"


@query(f"WITH {_TRAIN_GROUPS} SELECT grp AS \"group\", user_id, lo::BIGINT AS start, hi::BIGINT AS \"end\", array_to_string(list_concat(q[1:len(q) - 2], list_transform(range(16 - len(q) + 2), lambda x: -1)), '-') AS seq, array_to_string(q[-2:], '-') AS label, (len(q) - 2)::BIGINT AS n FROM c")
def training_rows_grouped(spark, d):
    """Training rows as a loader makes them of batches of 32 users, 512 rows a batch."""
    out = Q.training_rows(tokens(spark, d), "user_id", "tokens", 2, 16, 2, -1, -1, 512, 9, group_size=32)
    return out.select("group", "user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), joined("tokens").alias("seq"), joined("label").alias("label"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


# ---- vectors


def rounded(col):
    return F.array_join(F.transform(col, lambda x: F.round(x * 1e6).cast("long").cast("string")), "/")


def rounded_sql(expr):
    return f"array_to_string(list_transform({expr}, lambda x: round(x * 1000000)::BIGINT), '/')"


@query(f"WITH {E_SQL} SELECT item_id, {rounded_sql(UNIT.format(x='v'))} AS out FROM e")
def l2_normalize(spark, d):
    return items(spark, d).select("item_id", rounded(V.l2_normalize("embedding")).alias("out"))


@query(f"WITH {E_SQL}, x AS (SELECT item_id, unnest(range(1, len(v) + 1)) AS k, v FROM e), y AS (SELECT item_id, k, v[k] AS a FROM x), z AS (SELECT item_id, k, (a - avg(a) OVER w) / sqrt(var_pop(a) OVER w + 1e-5) AS s FROM y WINDOW w AS (PARTITION BY k)) SELECT item_id, string_agg(round(s * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM z GROUP BY item_id")
def standardize(spark, d):
    return V.standardize(items(spark, d), "item_id", "embedding").select("item_id", rounded(F.col("z")).alias("out"))


_NEAR = f"{E_SQL}, c AS (SELECT item_id AS code, v AS c FROM e WHERE item_id < 16), a AS (SELECT item_id, any_value(v) AS v, arg_min(code, row(list_distance(v, c), code)) AS code FROM e, c GROUP BY item_id)"


@query(f"WITH {_NEAR} SELECT item_id, code FROM a")
def assign(spark, d):
    return V.assign(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d, 1)[0]).select("item_id", F.col("code").cast("long").alias("code"))


@query(f"WITH {_NEAR} SELECT item_id, {rounded_sql('list_transform(list_zip(a.v, c.c), lambda z: z[1] - z[2])')} AS out FROM a JOIN c USING (code)")
def residuals(spark, d):
    return V.assign(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d, 1)[0]).select("item_id", rounded(F.col("residual")).alias("out"))


@query(f"WITH {E_SQL}, u AS (SELECT item_id, list_transform(v, lambda x: x * (1 + item_id % 7)) AS v FROM e), c AS (SELECT item_id AS code, list_transform(v, lambda x: x / (1 + item_id)) AS c FROM u WHERE item_id < 16) SELECT item_id, arg_min(code, row(1 - list_cosine_similarity(v, c), code)) AS code FROM u, c GROUP BY item_id")
def assign_cosine(spark, d):
    """Nearest by the angle alone: rows and centroids have lengths of their own."""
    longer = items(spark, d).select("item_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("item_id") % 7)).alias("v"))
    rows = longer.filter("item_id < 16").orderBy("item_id").collect()  # 16 rows
    book = np.array([r["v"] for r in rows]) / (1 + np.arange(16))[:, None]
    return V.assign(longer, "item_id", "v", book, V.cosine_distances).select("item_id", F.col("code").cast("long").alias("code"))


@query(f"WITH {E_SQL}, c AS (SELECT item_id AS code, v AS c FROM e WHERE item_id < 16) SELECT item_id, code, round(list_distance(v, c) ** 2, 6) AS distance FROM e, c")
def sq_distances(spark, d):
    e = items(spark, d)
    few = e.filter("item_id < 16").select(F.col("item_id").alias("code"), F.col("embedding").alias("c"))  # 16 rows
    return e.join(F.broadcast(few)).select("item_id", "code", F.round(V.squared_distance("embedding", "c"), 6).alias("distance"))


def _pairs(spark, d):
    return V.assign(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d, 1)[0]).join(items(spark, d), "item_id").withColumn("w", (F.col("item_id") % 3).cast("double"))


_SE = f"WITH {_NEAR}, p AS (SELECT item_id, len(v) AS n, list_distance(a.v, c.c) ** 2 AS se FROM a JOIN c USING (code)) "


@query(_SE + "SELECT round(sum((item_id % 3) * se), 6) AS sse FROM p")
def weighted_sse(spark, d):
    return V.weighted_sse(_pairs(spark, d), "embedding", "centroid", "w").select(F.round("sse", 6).alias("sse"))


@query(_SE + "SELECT round(1.25 * sum(se) / sum(n), 6) AS loss FROM p")
def beta_loss(spark, d):
    return V.beta_loss(_pairs(spark, d), "embedding", "centroid", 0.25, "mean").select(F.round("loss", 6).alias("loss"))


@query(_SE + "SELECT round(sum(se) / sum(n), 6) AS mse FROM p")
def mse(spark, d):
    return V.mse(_pairs(spark, d), "embedding", "centroid").select(F.round("mse", 6).alias("mse"))


_POOL = "WITH " + E_SQL + ", p AS (SELECT item_id, unnest(range(1 + item_id % 8)) AS pos, v FROM e), q AS (SELECT item_id, pos, v[8 * pos + 1:8 * pos + 8] AS x, max(pos) OVER (PARTITION BY item_id) AS hi FROM p), r AS (SELECT item_id, unnest(range(1, len(x) + 1)) AS k, x FROM q WHERE {keep}), m AS (SELECT item_id, k, avg(x[k]) AS a FROM r GROUP BY 1, 2) SELECT item_id, string_agg(round(a * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM m GROUP BY item_id"


def _tokens_of_items(spark, d):
    pieces = items(spark, d).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"), "embedding")
    return pieces.select("item_id", "pos", F.slice("embedding", F.col("pos") * 8 + 1, 8).cast("array<double>").alias("vec"), (F.col("pos") <= F.col("item_id") % 8).cast("int").alias("mask"))


@query(_POOL.replace("{keep}", "pos > hi - 3"))
def pool(spark, d):
    return V.pool(_tokens_of_items(spark, d), "item_id", "mean", 3).select("item_id", rounded(F.col("vec")).alias("out"))


@query(_POOL.replace("{keep}", "true"))
def pool_all(spark, d):
    return V.pool(_tokens_of_items(spark, d), "item_id").select("item_id", rounded(F.col("vec")).alias("out"))


@query(_POOL.replace("{keep}", "pos = hi"))
def pool_last(spark, d):
    return V.pool(_tokens_of_items(spark, d), "item_id", "last").select("item_id", rounded(F.col("vec")).alias("out"))


@query(_POOL.replace("{keep}", "pos = 0"))
def pool_first(spark, d):
    return V.pool(_tokens_of_items(spark, d), "item_id", "first").select("item_id", rounded(F.col("vec")).alias("out"))


@query(f"WITH {E_SQL} SELECT item_id, {rounded_sql('list_reverse(v)')} AS out FROM e")
def rotate(spark, d):
    width = items(spark, d).agg(F.max(F.size("embedding"))).first()[0]
    return V.rotate(items(spark, d), "item_id", "embedding", 2.0 * np.eye(width)[::-1]).select("item_id", rounded(F.col("rotated")).alias("out"))


@query(f"WITH {E_SQL}, k AS (SELECT item_id AS code, v AS c FROM e WHERE item_id < 16), l AS (SELECT item_id, code, list_cosine_similarity(v, c) AS logit FROM e, k) SELECT round(avg(ce), 6) AS ce FROM (SELECT item_id, ln(sum(exp(logit))) - max(logit) FILTER (code = item_id % 16) AS ce FROM l GROUP BY item_id)")
def full_softmax_ce(spark, d):
    rows = items(spark, d).withColumn("label", F.col("item_id") % 16)
    return V.full_softmax_ce(rows, "item_id", "embedding", "label", fixed_codebooks(spark, d, 1)[0]).select(F.round("ce", 6).alias("ce"))


@query(f"WITH {E_SQL}, l AS (SELECT q.item_id, (q.item_id * 7) % (SELECT count(*) FROM e) AS label, k.item_id AS code, list_cosine_similarity(q.v, k.v) AS logit FROM e q, e k) SELECT round(avg(ce), 6) AS ce FROM (SELECT item_id, ln(sum(exp(logit))) - max(logit) FILTER (code = label) AS ce FROM l GROUP BY item_id)")
def full_softmax_ce_blocks(spark, d):
    """All items as keys, in blocks."""
    rows = items(spark, d)
    keys = rows.select(F.col("item_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.withColumn("label", (F.col("item_id") * 7) % F.lit(rows.count()))
    return V.full_softmax_ce(asked, "item_id", "embedding", "label", keys, block=300).select(F.round("ce", 6).alias("ce"))


# ---- fits


@query(f"WITH {_NEAR}, b AS (SELECT code, count(*) AS n FROM a GROUP BY code), y AS (SELECT a.code, unnest(range(1, len(v) + 1)) AS k, v FROM a), m AS (SELECT code, k, avg(v[k]) AS m FROM y GROUP BY 1, 2), z AS (SELECT code, k, m + (c.c[k] - m) * 10.0 / (10 + n) AS x FROM m JOIN b USING (code) JOIN c USING (code)) SELECT code, any_value(n)::BIGINT AS n, string_agg(round(x * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM z JOIN b USING (code) GROUP BY code")
def minibatch_step(spark, d):
    start = kmeans.Codebook(fixed_codebooks(spark, d, 1)[0], np.full(16, 10.0))
    n, s, _ = kmeans.code_sums(items(spark, d), "embedding", start.centroids)
    new = kmeans.minibatch_update(start, n, s)
    rows = [(k, int(n[k]), new.centroids[k].tolist()) for k in np.flatnonzero(n).tolist()]
    return spark.createDataFrame(rows, "code long, n long, c array<double>").select("code", "n", rounded(F.col("c")).alias("out"))


_MEANS = f"{_NEAR}, n AS (SELECT code, count(*) AS n FROM a GROUP BY code), m AS (SELECT code, k, avg(v[k]) AS m FROM (SELECT code, v, unnest(range(1, len(v) + 1)) AS k FROM a) GROUP BY 1, 2)"


@query(f"WITH {_MEANS}, g AS (SELECT code, sum((c.c[k] - m) ** 2) AS gap FROM m JOIN c USING (code) GROUP BY code) SELECT round(sum(gap * n / (10.0 + n)), 6) AS loss FROM g JOIN n USING (code)")
def minibatch_loss(spark, d):
    start = kmeans.Codebook(fixed_codebooks(spark, d, 1)[0], np.full(16, 10.0))
    return spark.createDataFrame([(kmeans.minibatch_loss(start, *kmeans.code_sums(items(spark, d), "embedding", start.centroids)),)], "loss double").select(F.round("loss", 6).alias("loss"))


@query(_SE + "SELECT round(1.25 * sum(se), 6) AS loss FROM p")
def quantization_loss(spark, d):
    start = kmeans.Codebook(fixed_codebooks(spark, d, 1)[0])
    return spark.createDataFrame([(residual.quantization_loss(0.25)(start, *kmeans.code_sums(items(spark, d), "embedding", start.centroids)),)], "loss double").select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_MEANS}, z AS (SELECT m.code, k, c.c[k] - 0.5 * 2 * (n * c.c[k] - n * m) / (SELECT count(*) FROM e) AS x FROM m JOIN n USING (code) JOIN c USING (code)) SELECT code, string_agg(round(x * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM z GROUP BY code")
def gradient_step(spark, d):
    """One plain gradient step from fixed centroids."""
    start = kmeans.Codebook(fixed_codebooks(spark, d, 1)[0])
    n, s, _ = kmeans.code_sums(items(spark, d), "embedding", start.centroids)
    new = residual.gradient_move(0.5, adagrad=False)(start, n, s)
    rows = [(k, new.centroids[k].tolist()) for k in np.flatnonzero(n).tolist()]
    return spark.createDataFrame(rows, "code long, c array<double>").select("code", rounded(F.col("c")).alias("out"))


@query(f"WITH {_NEAR}, y AS (SELECT a.v AS x, c.c AS q FROM a JOIN c USING (code)), i AS (SELECT unnest(range(1, len(x) + 1)) AS i, x, q FROM y), j AS (SELECT i, x[i] AS xi, unnest(range(1, len(q) + 1)) AS j, q FROM i) SELECT (i - 1)::BIGINT AS i, (j - 1)::BIGINT AS j, round(sum(xi * q[j]), 6) AS total FROM j GROUP BY 1, 2")
def rotation_sums(spark, d):
    """The sums from which a rotation step is solved, before any rotation."""
    rows = items(spark, d).select("item_id", F.col("embedding").cast("array<double>").alias("_v"))
    book = fixed_codebooks(spark, d, 1)
    m, _ = residual.cross_sums(rows, "_v", np.eye(book[0].shape[1]), book, width=24)
    flat = [(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]
    return spark.createDataFrame(flat, "i long, j long, total double").withColumn("total", F.round("total", 6))


@query(f"WITH {E_SQL} SELECT {rounded_sql('v')} AS out FROM e ORDER BY md5(item_id || '-2'), item_id LIMIT 16")
def init_random(spark, d):
    found = kmeans.init_random(items(spark, d), "item_id", "embedding", 16, 2).centroids
    return spark.createDataFrame([(v.tolist(),) for v in found], "v array<double>").select(rounded(F.col("v")).alias("out"))


def _pick_sql(weights: str, u: float) -> str:
    """The first of the rows (ord, v, w) of ``weights`` at which the weights so far exceed the share ``u`` of all."""
    return f"SELECT ord, v FROM (SELECT ord, v, w, sum(w) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s, sum(w) OVER () AS total FROM {weights}) WHERE w > 0 AND s > {u!r} * total ORDER BY ord LIMIT 1"


def _kmeanspp_sql(p: str, points: str, k: int, seed: int) -> list[str]:
    """k-means++ of the rows (ord, v, w) of ``points`` as tables p_b(code, v): a choice and the distances after it in turn."""
    out = []
    for j in range(k):
        weights = points if j == 0 else f"(SELECT ord, v, w * d AS w FROM {p}_d{j - 1})"
        out.append(f"{p}_c{j} AS MATERIALIZED ({_pick_sql(weights, kmeans.fraction(seed, j))})")
        before = f"SELECT ord, v, w, list_distance(v, (SELECT v FROM {p}_c{j})) ** 2 AS d FROM {points}"
        if j:
            before = f"SELECT ord, v, w, least(d, list_distance(v, (SELECT v FROM {p}_c{j})) ** 2) AS d FROM {p}_d{j - 1}"
        out.append(f"{p}_d{j} AS MATERIALIZED ({before})")
    return [*out, f"{p}_b AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {j} AS code, v AS c FROM {p}_c{j}' for j in range(k))})"]


def _buffer_sql(p: str, rows: str, seed: int, size: int = 3072) -> str:
    return f"{p} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(item_id || '-{seed}'), item_id) AS ord, g AS v, 1.0::DOUBLE AS w FROM {rows} QUALIFY ord <= {size})"


def _zip_sql(a: str, b: str, each: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: {each})"


def _steps_sql(p: str, rows: str, first: str, steps: int, rule: str = "minibatch", lr: float = 0.1) -> list[str]:
    """``steps`` steps over the rows (item_id, g) from the centroids ``first``(code, c), as tables p_0 to p_steps (code, c, seen, grad) and losses p_l(step, loss)."""
    out, losses = [f"{p}_0 AS MATERIALIZED (SELECT code, c, 0.0::DOUBLE AS seen, list_transform(c, lambda x: 0.0::DOUBLE) AS grad FROM {first})"], []
    for i in range(steps):
        out.append(f"{p}_a{i} AS MATERIALIZED (SELECT item_id, any_value(g) AS g, arg_min(code, row(list_distance(g, c), code)) AS code FROM {rows}, {p}_{i} GROUP BY item_id)")
        out.append(f"{p}_m{i} AS MATERIALIZED (SELECT code, any_value(n)::DOUBLE AS n, list(m ORDER BY k) AS m FROM (SELECT code, k, count(*) AS n, avg(g[k]) AS m FROM (SELECT code, g, unnest(range(1, len(g) + 1)) AS k FROM {p}_a{i}) GROUP BY code, k) GROUP BY code)")
        joined_ = f"FROM {p}_{i} LEFT JOIN {p}_m{i} USING (code)"
        if rule == "minibatch":
            moved = _zip_sql("c", "m", "z[1] - (z[1] - z[2]) * (n / (seen + n))")
            out.append(f"{p}_{i + 1} AS MATERIALIZED (SELECT code, CASE WHEN n IS NULL THEN c ELSE {moved} END AS c, seen + coalesce(n, 0) AS seen, grad {joined_})")
            losses.append(f"SELECT {i} AS step, sum(list_distance(c, m) ** 2 * n / (seen + n)) AS loss FROM {p}_{i} JOIN {p}_m{i} USING (code)")
        else:
            g = f"CASE WHEN n IS NULL THEN list_transform(c, lambda x: 0.0::DOUBLE) ELSE {_zip_sql('c', 'm', '2 * n * (z[1] - z[2]) / many')} END"
            out.append(f"{p}_g{i} AS MATERIALIZED (SELECT code, c, seen, grad, {g} AS g {joined_} CROSS JOIN (SELECT count(*) AS many FROM {rows}))")
            out.append(f"{p}_h{i} AS MATERIALIZED (SELECT code, c, seen, g, {_zip_sql('grad', 'g', 'z[1] + z[2] * z[2]')} AS grad FROM {p}_g{i})")
            step = "list_transform(list_zip(c, g, grad), lambda z: z[1] - {lr} * z[2] / (sqrt(z[3]) + 1e-10))".replace("{lr}", repr(lr))
            out.append(f"{p}_{i + 1} AS MATERIALIZED (SELECT code, {step} AS c, seen, grad FROM {p}_h{i})")
    return [*out, *([f"{p}_l AS ({' UNION ALL '.join(losses)})"] if losses else [])]


def _fit_sql(layers: int, k: int, steps: int, residual_: bool = True, normalize: bool = True, rule: str = "minibatch", seed: int = 0) -> str:
    """A layered fit; the codebook of layer h ends up in q{h}_{steps}."""
    given = UNIT.format(x="r") if normalize else "r"
    out = [E_SQL, "r0 AS (SELECT item_id, v AS r FROM e)"]
    for h in range(layers):
        of = h if residual_ else 0
        out += [f"g{h} AS MATERIALIZED (SELECT item_id, r, {given} AS g FROM r{of})", _buffer_sql(f"s{h}", f"g{h}", seed + h), *_kmeanspp_sql(f"i{h}", f"s{h}", k, seed + h), *_steps_sql(f"q{h}", f"g{h}", f"i{h}_b", steps, rule)]
        if residual_ and h + 1 < layers:
            out.append(f"n{h} AS MATERIALIZED (SELECT item_id, any_value(r) AS r, arg_min(code, row(list_distance(g, c), code)) AS code FROM g{h}, q{h}_{steps} GROUP BY item_id)")
            out.append(f"r{h + 1} AS MATERIALIZED (SELECT item_id, {_zip_sql('r', 'c', 'z[1] - z[2]')} AS r FROM n{h} JOIN q{h}_{steps} USING (code))")
    return ", ".join(out)


def _books_sql(tables: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {h} AS layer, code, {rounded_sql('c')} AS centroid FROM {t}" for h, t in enumerate(tables))


_E0 = f"{E_SQL}, g0 AS (SELECT item_id, v AS g FROM e), {_buffer_sql('s0', 'g0', 0)}"


@query(f"WITH {_E0}, {', '.join(_kmeanspp_sql('i0', 's0', 16, 0))} {_books_sql(['i0_b'])}")
def init_kmeanspp(spark, d):
    return _books(spark, [kmeans.init_kmeanspp(kmeans.init_buffer(items(spark, d), "item_id", "embedding", 3072, 16), 16).centroids])


def _parallel_sql(k: int, rounds: int, oversample: float, seed: int) -> str:
    """k-means||: chosen rows of each round as w{step}, all as x, weighted as p(ord, v, w)."""
    out = [f"x0 AS MATERIALIZED (SELECT v FROM e ORDER BY md5(item_id || '-{seed}'), item_id LIMIT 1)"]
    for i in range(rounds):
        out.append(f"y{i} AS MATERIALIZED (SELECT item_id, any_value(e.v) AS v, min(list_distance(e.v, x{i}.v) ** 2) AS d FROM e, x{i} GROUP BY item_id)")
        chance = f"('0x' || substr(md5(item_id || '-{i}-{seed}'), 1, 13))::BIGINT / 4503599627370496::DOUBLE < d * ({oversample * k!r} / (SELECT sum(d) FROM y{i}))"
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT v FROM x{i} UNION SELECT v FROM y{i} WHERE {chance})")
    out.append(f"x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v) AS ord, v FROM x{rounds})")
    out.append("z AS (SELECT item_id, arg_min(ord, row(list_distance(e.v, x.v), ord)) AS ord FROM e, x GROUP BY item_id)")
    out.append("p AS MATERIALIZED (SELECT ord, v, coalesce(n, 0)::DOUBLE AS w FROM x LEFT JOIN (SELECT ord, count(*) AS n FROM z GROUP BY ord) USING (ord))")
    return ", ".join(out)


@query(f"WITH {E_SQL}, {_parallel_sql(16, 5, 2.0, 0)}, {', '.join(_kmeanspp_sql('i0', 'p', 16, 0))} {_books_sql(['i0_b'])}")
def init_kmeans_parallel(spark, d):
    return _books(spark, [kmeans.init_kmeans_parallel(items(spark, d), "item_id", "embedding", 16).centroids])


@query(f"WITH {_fit_sql(3, 16, 3)} {' UNION ALL '.join(f'SELECT {h} AS layer, round(avg(loss), 6) AS mean_loss FROM q{h}_l' for h in range(3))}")
def fit_history(spark, d):
    """The mean loss of each layer's steps."""
    history = residual.fit_rq(items(spark, d), "item_id", "embedding", 3, 16, 9)[1]
    rows = spark.createDataFrame(history, "layer int, step int, loss double")
    return residual.mean_metric(rows, ["layer"], "loss").withColumn("mean_loss", F.round("mean_loss", 6))


@query(f"WITH {E_SQL} SELECT {rounded_sql('v')} AS out FROM e ORDER BY md5(item_id || '-4'), item_id LIMIT 48")
def init_buffer(spark, d):
    found = kmeans.init_buffer(items(spark, d), "item_id", "embedding", 48, 8, 4)
    return spark.createDataFrame([(v.tolist(),) for v in found], "v array<double>").select(rounded(F.col("v")).alias("out"))


def _books(spark, books):
    rows = [(h, c, v.tolist()) for h, m in enumerate(books) for c, v in enumerate(m)]
    return spark.createDataFrame(rows, "layer int, code int, centroid array<double>").withColumn("centroid", rounded(F.col("centroid")))


@query(f"WITH {_E0}, {', '.join(_kmeanspp_sql('i0', 's0', 8, 0))}, {', '.join(_steps_sql('q0', 'g0', 'i0_b', 10))} {_books_sql(['q0_10'])}")
def fit_kmeans(spark, d):
    return _books(spark, [kmeans.fit_kmeans(items(spark, d), "item_id", "embedding", 8, 10)[0].centroids])


@query(f"WITH {_fit_sql(3, 16, 3)} {_books_sql([f'q{h}_3' for h in range(3)])}")
def fit_rq(spark, d):
    return _books(spark, residual.fit_rq(items(spark, d), "item_id", "embedding", 3, 16, 9)[0])


@query(f"WITH {E_SQL}, {_parallel_sql(16, 5, 2.0, 3)}, {', '.join(_kmeanspp_sql('i0', 'p', 16, 3))}, g0 AS (SELECT item_id, v AS g FROM e), {', '.join(_steps_sql('q0', 'g0', 'i0_b', 3))} {_books_sql(['q0_3'])}")
def fit_rq_parallel(spark, d):
    """A layer that begins with k-means|| of all rows instead of k-means++ of a buffer."""
    return _books(spark, residual.fit_rq(items(spark, d), "item_id", "embedding", 1, 16, 3, normalize=False, seed=3, init=kmeans.init_kmeans_parallel)[0])


@query(f"WITH {_fit_sql(2, 16, 3, residual_=False)} {_books_sql([f'q{h}_3' for h in range(2)])}")
def fit_mlq(spark, d):
    return _books(spark, residual.fit_rq(items(spark, d), "item_id", "embedding", 2, 16, 6, residual=False)[0])


@query(f"WITH {_fit_sql(2, 16, 3, rule='gradient')} {_books_sql([f'q{h}_3' for h in range(2)])}")
def fit_rvq(spark, d):
    return _books(spark, residual.fit_rvq(items(spark, d), "item_id", "embedding", 2, 16, 6)[0])


@query()
def fit_opq(spark, d):
    return _books(spark, residual.fit_opq(items(spark, d), "item_id", "embedding", 2, 8, 2, 4)[1])


_SOFT = f"""{E_SQL}, c AS (SELECT item_id AS code, v AS c FROM e WHERE item_id < 16),
l AS (SELECT item_id, code, c, {{noise}} - list_distance(v, c) ** 2 AS logit FROM e, c), w AS (SELECT item_id, code, c, logit, exp((logit - max(logit) OVER (PARTITION BY item_id)) / 0.7) AS w FROM l),
x AS (SELECT item_id, w, c, unnest(range(1, len(c) + 1)) AS k FROM w), y AS (SELECT item_id, k, sum(w * c[k]) / sum(w) AS x FROM x GROUP BY 1, 2), z AS (SELECT item_id, string_agg(round(x * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM y GROUP BY item_id)
SELECT item_id, arg_min(code, row(-logit, code)) AS code, any_value(out) AS out FROM w JOIN z USING (item_id) GROUP BY item_id"""


def _soft(spark, d, noise):
    found = residual.assign_soft(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d, 1)[0], noise=noise)
    return found.select("item_id", F.col("code").cast("long").alias("code"), rounded(F.col("vector")).alias("out"))


@query(f"WITH {_SOFT.format(noise='0')}")
def assign_soft(spark, d):
    return _soft(spark, d, False)


def _mixed_sql(h: str) -> str:
    """32 bits stirred, on 64-bit whole numbers; each step is a name of its own, so that the text does not grow."""
    for shift, times in ((16, 2246822507), (13, 3266489909)):
        h = f"list_transform([{h}], lambda x: (xor(x, x >> {shift})::HUGEINT * {times} % 4294967296)::BIGINT)[1]"
    return f"list_transform([{h}], lambda x: xor(x, x >> 16))[1]"


def _u32_sql(seed: int) -> str:
    of_seed = _mixed_sql(f"{seed}::BIGINT")
    high = _mixed_sql(f"xor(e.item_id >> 32, {of_seed})")
    of_key = _mixed_sql(f"xor(e.item_id & 4294967295, {high})")
    return f"(({_mixed_sql(f'xor({of_key}, ' + _mixed_sql('c.code') + ')')} + 0.5::DOUBLE) / 4294967296::DOUBLE)"


@query(f"""WITH {_SOFT.format(noise=f"-ln(-ln({_u32_sql(0)}))")}""")
def assign_soft_noise(spark, d):
    return _soft(spark, d, True)


def _soft_layer_sql(h: int, seed: int) -> str:
    """x{h + 1} (item_id, r, code): the soft layer h of the rows x{h} (item_id, r)."""
    return f"""u{h} AS MATERIALIZED (SELECT item_id, r, {UNIT.format(x="r")} AS g FROM x{h}), k{h} AS (SELECT code, c FROM b WHERE layer = {h}),
l{h} AS (SELECT e.item_id, c.code, c.c, e.r, -ln(-ln({_u32_sql(seed + h)})) - list_distance(e.g, c.c) ** 2 AS logit FROM u{h} e, k{h} c),
w{h} AS MATERIALIZED (SELECT item_id, code, c, r, logit, exp((logit - max(logit) OVER (PARTITION BY item_id)) / 0.7) AS w FROM l{h}),
y{h} AS (SELECT item_id, list(y ORDER BY k) AS y FROM (SELECT item_id, k, sum(w * c[k]) / sum(w) AS y FROM (SELECT item_id, w, c, unnest(range(1, len(c) + 1)) AS k FROM w{h}) GROUP BY item_id, k) GROUP BY item_id),
x{h + 1} AS MATERIALIZED (SELECT item_id, {_zip_sql("any_value(r)", "any_value(y)", "z[1] - z[2]")} AS r, arg_min(code, row(-logit, code)) AS code{h} FROM w{h} JOIN y{h} USING (item_id) GROUP BY item_id)"""


@query(f"""WITH {E_SQL}, b AS (SELECT item_id // 16 AS layer, item_id % 16 AS code, list_transform(v, lambda a: a * power(0.5, item_id // 16)) AS c FROM e WHERE item_id < 32), x0 AS (SELECT item_id, v AS r FROM e),
{_soft_layer_sql(0, 7)}, {_soft_layer_sql(1, 7)} SELECT item_id, code0 || '-' || code1 AS sid, round(sqrt(list_inner_product(x2.r, x2.r)), 6) AS left_over FROM x1 JOIN x2 USING (item_id)""")
def assign_rq_soft(spark, d):
    """Two layers that quantise softly, with noise: another strategy than the nearest centroid."""
    out = residual.assign_rq(items(spark, d), "item_id", "embedding", fixed_codebooks(spark, d), strategy=residual.soft(0.7, 7))
    return out.select("item_id", joined("sid").alias("sid"), F.round(F.sqrt(F.col("norms")[2]), 6).alias("left_over"))


@query("SELECT user_id, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id")
def mean_metric(spark, d):
    return residual.mean_metric(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "value").withColumn("mean_value", F.round("mean_value", 6))


# ---- code tables


@query(f"WITH {SID_SQL} SELECT item_id, array_to_string(sid, '-') AS sid, CASE WHEN count(*) OVER (PARTITION BY sid) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY sid ORDER BY item_id) END AS digit FROM i")
def dedup_sids(spark, d):
    return I.dedup_sids(plain_sids(spark, d)).select("item_id", joined("sid").alias("sid"), F.col("digit").cast("long").alias("digit"))


@query(f"WITH {SID_SQL} SELECT unnest([0, 1]) AS hierarchy, item_id, unnest(sid) AS code FROM i")
def transpose_sids(spark, d):
    return I.transpose_sids(plain_sids(spark, d))


@query(f"WITH {SID_SQL} SELECT max(len(sid))::BIGINT AS hierarchies, (max(list_max(sid)) + 1)::BIGINT AS codebook_size FROM i")
def sid_shape(spark, d):
    return I.sid_shape(plain_sids(spark, d)).select(F.col("hierarchies").cast("long").alias("hierarchies"), F.col("codebook_size").cast("long").alias("codebook_size"))


_PRE = "p AS (SELECT doc_id, [(doc_id % 13)::INT, (doc_id % 5)::INT][1:1 + doc_id % 2] AS prefix FROM documents)"


def _prefixes(spark, d):
    ids = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return ids.withColumn("prefix", F.slice(F.array((F.col("doc_id") % 13).cast("int"), (F.col("doc_id") % 5).cast("int")), F.lit(1), (1 + F.col("doc_id") % 2).cast("int")))


@query(f"WITH {SID_SQL}, {_PRE}, k AS (SELECT DISTINCT sid AS x FROM i UNION SELECT DISTINCT sid[1:1] FROM i) SELECT doc_id, x IS NOT NULL AS valid FROM p LEFT JOIN k ON prefix = x")
def valid_prefix(spark, d):
    return I.valid_prefix(_prefixes(spark, d), plain_sids(spark, d)).select("doc_id", "valid")


@query(f"WITH {SID_SQL}, {_PRE} SELECT doc_id, item_id FROM p JOIN i ON prefix = sid")
def resolve(spark, d):
    return I.resolve(_prefixes(spark, d).withColumnRenamed("prefix", "sid"), plain_sids(spark, d)).select("doc_id", "item_id")


# ---- candidates and evaluation

_LOGIT = f"{SEQ_SQL}, {SID_SQL}, x AS (SELECT user_id, unnest(seq) AS item_id FROM s), y AS (SELECT user_id, sid FROM x JOIN i USING (item_id)), l1 AS (SELECT user_id, sid[1] AS c1, count(*) AS n FROM y GROUP BY 1, 2), l2 AS (SELECT user_id, sid[1] AS c1, sid[2] AS c2, count(*) AS n FROM y GROUP BY 1, 2, 3)"
_BEAM = f"""{_LOGIT}, p1 AS (SELECT user_id, c1, n / sum(n) OVER (PARTITION BY user_id) AS p FROM l1), t1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(p, 12) DESC, c1) <= 6),
p2 AS (SELECT l2.user_id, l2.c1, l2.c2, t1.p * n / sum(n) OVER (PARTITION BY l2.user_id, l2.c1) AS p FROM l2 JOIN t1 ON l2.user_id = t1.user_id AND l2.c1 = t1.c1),
t2 AS (SELECT user_id, c1, c2, p, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 12) DESC, c1, c2) AS rank FROM p2 QUALIFY rank <= 6)"""


def logits(spark, d, seqs=None):
    rows = (sequences(spark, d) if seqs is None else seqs).select("user_id", F.explode("seq").alias("item_id")).join(plain_sids(spark, d), "item_id")
    grown = rows.select("user_id", F.explode(F.array(*[F.struct(F.slice("sid", 1, h).alias("prefix"), F.col("sid")[h].alias("code")) for h in (0, 1)])).alias("x"))
    return grown.groupBy("user_id", "x.prefix", "x.code").agg(F.log(F.count("*")).alias("logit"))


@query(f"WITH {_BEAM} SELECT user_id, c1::VARCHAR AS prefix, round(p, 6) AS probability FROM t1")
def beam_step(spark, d):
    table = logits(spark, d)
    start = table.select("user_id").distinct().select("user_id", F.array().cast("array<int>").alias("prefix"), F.lit(1.0).alias("probability"))
    return decode.beam_step(start, table, 6, plain_sids(spark, d)).select("user_id", joined("prefix").alias("prefix"), F.round("probability", 6).alias("probability"))


@query(f"WITH {_BEAM} SELECT user_id, rank, c1 || '-' || c2 AS sid, round(p, 6) AS probability FROM t2")
def beam_decode(spark, d):
    out = decode.beam_decode(logits(spark, d), 2, 6, plain_sids(spark, d))
    return out.select("user_id", F.col("rank").cast("long").alias("rank"), joined("sid").alias("sid"), F.round("probability", 6).alias("probability"))


def candidates(spark, d):
    seqs = S.settle(sequences(spark, d), "histories")
    preds = decode.beam_decode(logits(spark, d, seqs), 2, 6, plain_sids(spark, d)).withColumn("pos", F.col("rank") - 1).withColumnRenamed("probability", "score")
    last = seqs.select("user_id", F.element_at("seq", -1).alias("item_id")).join(plain_sids(spark, d), "item_id").select("user_id", "sid")
    return metrics.match_labels(preds.withColumn("score", F.round("score", 9)), last)


_CAND = f"{_BEAM}, lab AS (SELECT user_id, sid FROM (SELECT user_id, seq[-1] AS item_id FROM s) JOIN i USING (item_id)), cand AS (SELECT t2.user_id, rank, (c1 = sid[1] AND c2 = sid[2]) AS target FROM t2 JOIN lab USING (user_id)), m AS (SELECT user_id, max(CASE WHEN target AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg_5, max(CASE WHEN target AND rank <= 5 THEN 1.0 ELSE 0 END) AS recall_5, max(CASE WHEN target AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg_3, max(CASE WHEN target AND rank <= 3 THEN 1.0 ELSE 0 END) AS recall_3 FROM cand GROUP BY user_id)"


@query(f"WITH {_CAND} SELECT user_id, rank - 1 AS pos, target FROM cand")
def match_labels(spark, d):
    return candidates(spark, d).select("user_id", F.col("pos").cast("long").alias("pos"), "target")


@query(f"WITH {_CAND} SELECT user_id, round(ndcg_5, 6) AS ndcg_5 FROM m")
def ndcg(spark, d):
    return metrics.ndcg(candidates(spark, d), 5).withColumn("ndcg_5", F.round("ndcg_5", 6))


@query(f"WITH {_CAND} SELECT user_id, recall_5::DOUBLE AS recall_5 FROM m")
def recall(spark, d):
    return metrics.recall(candidates(spark, d), 5)


@query(f"WITH {_CAND} SELECT round(avg(ndcg_3), 6) AS ndcg_3, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, count(*) AS users FROM m")
def evaluate(spark, d):
    out = metrics.evaluate(candidates(spark, d), [3, 5])
    return out.select(*[F.round(c, 6).alias(c) if c != "users" else c for c in out.columns])


_RANKS = _CAND.replace("max(CASE WHEN target AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg_5", "max(CASE WHEN target AND rank <= 5 THEN 1 / rank ELSE 0 END) AS mrr_5")


@query(f"WITH {_RANKS} SELECT round(avg(mrr_5), 6) AS mrr_5, round(avg(recall_5), 6) AS recall_5, count(*) AS users FROM m")
def evaluate_plugged(spark, d):
    """Another metric beside one of the library's."""
    out = metrics.evaluate(candidates(spark, d), [5], {"mrr": metrics.MRR, "recall": metrics.RECALL})
    return out.select(F.round("mrr_5", 6).alias("mrr_5"), F.round("recall_5", 6).alias("recall_5"), "users")


def _asked(spark, d):
    e = items(spark, d)
    return e.select(F.col("item_id").alias("id"), F.col("embedding").alias("vec"), ((F.col("item_id") * 7) % 97).alias("positive")), e.select(F.col("item_id").alias("id"), F.col("embedding").alias("vec"))


_RET = f"{E_SQL}, r AS (SELECT q.item_id AS query_id, k.item_id AS key_id, round(list_inner_product(q.v, k.v), 9) AS score FROM e q, e k), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS pos FROM r QUALIFY pos <= 10)"


@query(f"WITH {_RET} SELECT query_id, pos, key_id, round(score, 6) AS score FROM t")
def retrieve_all(spark, d):
    q, k = _asked(spark, d)
    return metrics.retrieve_all(q, k, 10).select("query_id", F.col("pos").cast("long").alias("pos"), "key_id", F.round("score", 6).alias("score"))


_UNEVEN = f"{E_SQL}, y AS (SELECT item_id, list_transform(v, lambda x: x * exp(-(item_id % 37) / 6.0)) AS v FROM e), r AS (SELECT q.item_id AS query_id, k.item_id AS key_id, round(list_inner_product(q.v, k.v), 9) AS score FROM e q, y k), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS pos FROM r QUALIFY pos <= 10)"


@query(f"WITH {_UNEVEN} SELECT query_id, pos, key_id, round(score, 6) AS score FROM t")
def retrieve_uneven(spark, d):
    """Keys of uneven norms: most of them are bounded away."""
    q, k = _asked(spark, d)
    shorter = k.withColumn("vec", F.transform("vec", lambda x: x.cast("double") * F.exp(-(F.col("id") % 37) / 6.0)))
    found = metrics.retrieve_all(q, shorter, 10)
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "key_id", F.round("score", 6).alias("score"))


_NEG = f"{E_SQL}, n AS (SELECT count(*) AS n FROM e), x AS (SELECT item_id AS query_id, v, (item_id * 7) % 97 AS positive, unnest(range(501)) AS pos FROM e), y AS (SELECT *, CASE WHEN pos = 0 THEN positive ELSE ('0x' || substr(md5(query_id || '-' || pos || '-0'), 1, 8))::BIGINT % (n - 100) + 100 END AS key_id FROM x, n)"


@query(f"WITH {_NEG} SELECT query_id, pos, key_id, round(list_inner_product(y.v, e.v), 6) AS score, key_id = positive AS target FROM y JOIN e ON e.item_id = key_id")
def sample_negatives(spark, d):
    q, k = _asked(spark, d)
    return metrics.sample_negatives(q, k).select("query_id", F.col("pos").cast("long").alias("pos"), "key_id", F.round("score", 6).alias("score"), "target")


@query(f"WITH {_RET}, h AS (SELECT query_id, max(CASE WHEN key_id = (query_id * 7) % 97 THEN 1 / log2(pos + 1) ELSE 0 END) AS g, max(CASE WHEN key_id = (query_id * 7) % 97 THEN 1.0 ELSE 0 END) AS r FROM t GROUP BY query_id) SELECT round(avg(g), 6) AS ndcg_10, round(avg(r), 6) AS recall_10, count(*) AS users FROM h")
def evaluate_retrieval(spark, d):
    q, k = _asked(spark, d)
    out = metrics.evaluate_retrieval(q, k, [10])
    return out.select(F.round("ndcg_10", 6).alias("ndcg_10"), F.round("recall_10", 6).alias("recall_10"), "users")


@query(f"""WITH {_NEG}, z AS (SELECT query_id, pos, key_id = positive AS target, list_inner_product(y.v, e.v) AS score FROM y JOIN e ON e.item_id = key_id),
r AS (SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, (sum(target::INT) OVER (PARTITION BY query_id))::BIGINT AS positives FROM z),
u AS (SELECT query_id, least(any_value(positives), 10) AS most, sum(CASE WHEN target AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum((target AND rank <= 10)::INT) AS hits FROM r GROUP BY query_id)
SELECT round(avg(dcg / list_sum(list_transform(range(1, most + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_10, round(avg(hits / most), 6) AS recall_10, count(*) AS users FROM u""")
def evaluate_retrieval_sampled(spark, d):
    q, k = _asked(spark, d)
    out = metrics.evaluate_retrieval(q, k, [10], sampled=500)
    return out.select(F.round("ndcg_10", 6).alias("ndcg_10"), F.round("recall_10", 6).alias("recall_10"), "users")


_RUNS = "r AS (SELECT event_type AS dataset, 'm' || user_id % 3 AS method, user_id AS step, 'val/recall@5' AS metric, round(avg(value), 6) AS value FROM events GROUP BY ALL)"


def runs(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"), F.col("user_id").alias("step"))
    return rows.agg(F.round(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("val/recall@5"))


@query(f"WITH {_RUNS} SELECT dataset, method, max(value) AS best, min(value) AS worst FROM r GROUP BY dataset, method")
def compare_runs(spark, d):
    per = runs(spark, d).groupBy("dataset", "method").agg(F.max("value").alias("best"), F.min("value").alias("worst"))
    long = per.select("dataset", "method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("best", "worst")])).alias("x")).select("dataset", "method", "x.*")
    return metrics.compare_runs(long, ["best", "worst"])


@query(f"WITH {_RUNS} SELECT dataset, method, step, value FROM r QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY value DESC, step, method) = 1")
def best_run(spark, d):
    return metrics.best_run(runs(spark, d))


# ---- streams


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/embeddings.parquet").schema
    # as a pattern, the path may name a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{d}/embeddings.parque[t]")


@query(f"WITH {_codes_sql(True)} SELECT item_id, c1 || '-' || c2 AS sid FROM q")
def assign_stream(spark, d):
    """The embeddings as a stream, its codes appended to a table that is read back."""
    folder = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    found = T.assign_stream(_stream(spark, d), "vec_id", "embedding", fixed_codebooks(spark, d)).select(F.col("vec_id").alias("item_id"), joined("sid").alias("sid"))
    found.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("item_id", "sid")


@query(f"WITH {_MEANS} SELECT code, n::BIGINT AS n, string_agg(round(m * 1000000)::BIGINT::VARCHAR, '/' ORDER BY k) AS out FROM m JOIN n USING (code) GROUP BY code, n")
def fit_stream(spark, d):
    """The state after the embeddings as one micro-batch from fixed centroids: touched codes are at their means."""
    folder = f"{shared_folder(spark)}/fit-{uuid.uuid4().hex}"
    start = kmeans.Codebook(fixed_codebooks(spark, d, 1)[0])
    q = T.fit_stream(_stream(spark, d), "embedding", start, f"{folder}/state", f"{folder}/checkpoint")
    q.awaitTermination()
    state = T.read_state(spark, f"{folder}/state/{q.id}", 0)
    rows = [(k, int(state.counts[k]), state.centroids[k].tolist()) for k in np.flatnonzero(state.counts).tolist()]
    return spark.createDataFrame(rows, "code long, n long, c array<double>").select("code", "n", rounded(F.col("c")).alias("out"))


_THREE = "g0 AS (SELECT item_id, v AS g FROM e), b0 AS (SELECT item_id AS code, v AS c FROM e WHERE item_id < 16), t0 AS (SELECT code, c, 0.0::DOUBLE AS seen FROM b0)"


def _batch_sql(i: int) -> list[str]:
    """Table t{i + 1} (code, c, seen): t{i} after a step over the items of the i-th of three batches."""
    moved = _zip_sql("c", "m", "z[1] - (z[1] - z[2]) * (n / (seen + n))")
    return [
        f"a{i} AS (SELECT item_id, any_value(g) AS g, arg_min(code, row(list_distance(g, c), code)) AS code FROM g0, t{i} WHERE item_id % 3 = {i} GROUP BY item_id)",
        f"m{i} AS (SELECT code, any_value(n)::DOUBLE AS n, list(m ORDER BY k) AS m FROM (SELECT code, k, count(*) AS n, avg(g[k]) AS m FROM (SELECT code, g, unnest(range(1, len(g) + 1)) AS k FROM a{i}) GROUP BY code, k) GROUP BY code)",
        f"t{i + 1} AS MATERIALIZED (SELECT code, CASE WHEN n IS NULL THEN c ELSE {moved} END AS c, seen + coalesce(n, 0) AS seen FROM t{i} LEFT JOIN m{i} USING (code))",
    ]


@query(f"WITH {E_SQL}, {_THREE}, {', '.join(x for i in range(3) for x in _batch_sql(i))} SELECT code, seen::BIGINT AS n, {rounded_sql('c')} AS out FROM t3")
def fit_stream_batches(spark, d):
    """Three micro-batches, each a step from the state of the one before."""
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    rows = items(spark, d).select("item_id", "embedding")
    for k in range(3):  # a file a batch, read in the order they were written in
        rows.filter(F.col("item_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = T.fit_stream(stream, "embedding", kmeans.Codebook(fixed_codebooks(spark, d, 1)[0]), f"{folder}/state", f"{folder}/checkpoint")
    q.awaitTermination()
    state = T.read_state(spark, f"{folder}/state/{q.id}", 2)
    found = [(k, int(n), c.tolist()) for k, (c, n) in enumerate(zip(state.centroids, state.counts, strict=True))]
    return spark.createDataFrame(found, "code long, n long, c array<double>").select("code", "n", rounded(F.col("c")).alias("out"))
