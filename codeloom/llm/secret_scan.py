"""Secret scans by multipart credential linking, native.

Base spans are matches of single patterns. Weak parts (identifiers, long
tokens, endpoints) mean nothing alone; an interval join within scopes tells
which of them have their complementary parts nearby, none of them overlapping,
and only those are reported beside the base spans.

Positions come without a UDF: the pieces between a pattern's matches and the
matches themselves alternate, so a running sum of their lengths over a
document gives every start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The patterns of the weak kinds.
IDENT = r"""(?i)(?:client_?id|access_?key_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
LONG = r"[A-Za-z0-9+/_=-]{40,}"
ENDPOINT = r"(?i)[a-z][a-z0-9+]{1,15}://[a-z0-9.-]+(?::[0-9]+)?"

#: Kind, its order among spans that start together, its role, what a weak kind needs within its scope.
BASE = {"assign": (1, "secret"), "access": (2, "ident"), "hex": (3, "secret")}
WEAK = {"ident": (4, "ident", ("secret",)), "long": (5, "secret", ("ident",)), "endpoint": (6, "endpoint", ("ident", "secret"))}
#: Starts of parts that belong together lie at most so many code points apart.
SCOPE = 240

_ANY = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDS = ("client", "access", "account", "user", "login")


def _contains(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def _hits(kind: str, text: Column, pattern: str, guard: Column, value_group: int = 0) -> Column:
    """Array of (kind, k, gap before match k, its length, the length of its value)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    rows = F.transform(
        zipped,
        lambda x, k: F.struct(
            F.lit(kind).alias("kind"),
            k.alias("k"),
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["hit"]).alias("hit"),
            F.char_length(x["value"]).alias("value"),
        ),
    )
    return F.when(guard, F.filter(rows, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,k:int,gap:int,hit:int,value:int>>"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each match of each kind: (_id, _h, _n, kind, start, end), _h and _n telling rows with one id apart; repeats of a row give its parts once."""
    text, low = F.col("_text"), F.col("_low")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.xxhash64(text).alias("_h"), F.char_length(text).alias("_n"), text, F.lower(text).alias("_low"))
    arrays = F.concat(
        _hits("assign", text, ASSIGN, _contains(low, _ANY), 2),
        _hits("access", text, ACCESS, text.contains("AKIA")),
        _hits("hex", text, HEX, text.rlike(HEX)),
        _hits("ident", text, IDENT, _contains(low, _IDS)),
        _hits("long", text, LONG, text.rlike(LONG)),
        _hits("endpoint", text, ENDPOINT, text.contains("://")),
    )
    found = rows.select("_id", "_h", "_n", F.explode(arrays).alias("m")).select("_id", "_h", "_n", "m.*").distinct()
    before = Window.partitionBy("_id", "_h", "_n", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("hit")).over(before).cast("int")
    found = found.select("_id", "_h", "_n", "kind", (end - F.col("hit")).alias("start"), end.alias("end"), "value")
    return found.filter("kind != 'assign' OR value >= 6").drop("value")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have, within ``scope``, a part of every role that they need, where these parts and the weak one are disjoint.

    Parts meet in bins of one scope's width, each part of a needed role in its
    own bin and both neighbours, so a weak part meets what begins within two
    scopes of it and no more. An identifier and a secret that are disjoint
    exist if the first end of one role lies at or before the last start of the
    other, so four sums a weak part decide.
    """
    key = ["_id", "_h", "_n"]
    role = F.create_map(*[F.lit(x) for k, v in (BASE | WEAK).items() for x in (k, v[1])])
    bin_of = F.floor(F.col("start") / scope)
    weak = parts.filter(F.col("kind").isin(*WEAK)).select(*key, "kind", "start", "end", bin_of.alias("bin"))
    near = parts.select(*key, F.col("start").alias("p_start"), F.col("end").alias("p_end"), role[F.col("kind")].alias("role"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin")).filter("role != 'endpoint'")
    a, b = weak.alias("a"), near.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "bin")]
    apart = (F.col("p_end") <= F.col("start")) | (F.col("p_start") >= F.col("end"))
    met = a.join(b, [*same, F.abs(F.col("start") - F.col("p_start")) <= scope, apart]).select("a.*", "role", "p_start", "p_end")
    one = lambda r, c: F.when(F.col("role") == r, F.col(c))
    sums = [f(one(r, c)).alias(f"{r}_{c}") for r in ("ident", "secret") for f, c in ((F.max, "p_start"), (F.min, "p_end"))]
    met = met.groupBy(*key, "kind", "start", "end").agg(*sums)
    both = (F.col("ident_p_end") <= F.col("secret_p_start")) | (F.col("secret_p_end") <= F.col("ident_p_start"))
    has = {"ident": F.col("ident_p_end").isNotNull(), "secret": F.col("secret_p_end").isNotNull()}
    found = F.lit(False)
    for kind, (_, _, needs) in WEAK.items():
        found = found | ((F.col("kind") == kind) & (has[needs[0]] if len(needs) == 1 else both))
    return met.filter(found).select(*key, "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: the id and ``found``, its spans by start, then kind, as array of (start, rank, kind, end).

    A null text is empty; rows with a null id are kept; rows that share an id
    are scanned apart, and rows that repeat an id and a text each have its
    spans. Texts of any length are scanned whole. Other columns are ignored. A
    row without spans has an empty array; an empty table gives an empty one.
    """
    key = ["_id", "_h", "_n"]
    parts = settle(find_parts(docs, id_col, text_col))
    spans = parts.filter(F.col("kind").isin(*BASE)).unionByName(link(parts, scope))
    rank = F.create_map(*[F.lit(x) for k, v in (BASE | WEAK).items() for x in (k, v[0])])
    per_doc = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("found"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.char_length(text).alias("_n"))
    a, b = rows.alias("a"), per_doc.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return joined.select(F.col("a._id").alias(id_col), F.coalesce(F.col("b.found"), nothing).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir):
    from ._shared import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def _sql_hits(kind, rank, role, pattern, group=0, rest=""):
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rnk, '{role}' AS role, ends - len(hit) AS s, ends AS e FROM (
    SELECT doc_id, hit, value, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS ends FROM (
      SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals,
               string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')))) {rest}"""


def _near_sql(role: str, name: str) -> str:
    return f"{name}.doc_id = p.doc_id AND {name}.role = '{role}' AND abs({name}.s - p.s) <= {SCOPE} AND ({name}.e <= p.s OR {name}.s >= p.e)"


def _need_sql(needs: tuple) -> str:
    if len(needs) == 1:
        return f"EXISTS (SELECT 1 FROM p q WHERE {_near_sql(needs[0], 'q')})"
    return f"EXISTS (SELECT 1 FROM p q, p r WHERE {_near_sql(needs[0], 'q')} AND {_near_sql(needs[1], 'r')} AND (q.e <= r.s OR r.e <= q.s))"


_WEAK_SQL = " UNION ALL ".join(f"SELECT p.* FROM p WHERE kind = '{k}' AND {_need_sql(v[2])}" for k, v in WEAK.items())
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join([
    _sql_hits("assign", 1, "secret", ASSIGN, 2, "WHERE len(value) >= 6"),
    _sql_hits("access", 2, "ident", ACCESS),
    _sql_hits("hex", 3, "secret", HEX),
    _sql_hits("ident", 4, "ident", IDENT),
    _sql_hits("long", 5, "secret", LONG),
    _sql_hits("endpoint", 6, "endpoint", ENDPOINT),
])}),
spans AS (SELECT * FROM p WHERE rnk <= 3 UNION ALL {_WEAK_SQL}),
said AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rnk) FILTER (rnk <= 3) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rnk) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (doc_id)
"""
