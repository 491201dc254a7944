"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (domain, language, source). At each node its
children share the node's budget by weight; what a child cannot use goes to
its siblings first, and only what all of them cannot use reaches the parent's
siblings, because a node's own capacity is the sum of its leaves'. Each leaf
then takes whole seeded epochs and the longest token-prefix of one more.

A leaf's prefix is found without sorting the leaf: token sums over slots of
the seeded hash tell in which slot the budget ends, and only that slot's rows
are put in order. Selecting is then a comparison with one row per leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, others, settle

HASH_BITS = 60


WORD = r"[^ \t\n\r]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded(doc_id: Column, seed: int, epoch: Column) -> Column:
    """A 60-bit place in the order of an epoch."""
    said = F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)), epoch.cast("string"))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _edge(rows: DataFrame, parent: Sequence[str], key: Column) -> DataFrame:
    """Of each parent the first ``key``, in rising order, whose children are not full: (parent..., key, given, c_before, w_after, cap, weight), with the sums of that key and of what comes before and after it.

    ``rows`` (parent..., cap, weight, ratio, given, c_before, w_after) are
    added up by key first; keys rise with the ratio.
    """
    sums = rows.groupBy(*parent, key.alias("key")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("ratio").alias("most"), *[F.first(c).alias(c) for c in ("given", "c_before", "w_after")])
    by = Window.partitionBy(*parent)
    upto, after = by.orderBy("key"), by.orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("c_upto", F.col("c_before") + F.sum("cap").over(upto)).withColumn("w_after", F.col("w_after") + F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
    open_ = sums.filter(F.col("c_upto") + F.col("most") * F.col("w_after") > F.col("given"))
    first = F.min_by(F.struct("key", "given", (F.col("c_upto") - F.col("cap")).alias("c_before"), "w_after", "cap", "weight"), "key")
    return open_.groupBy(*parent).agg(first.alias("e")).select(*parent, "e.*")


#: Widths of the bins in which the level is looked for, in parts of a doubling of the ratio.
STEPS = (16, 1 << 16)


def share(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Add ``budget``: each parent's ``given`` tokens over its children (``cap``, ``weight``), by water-filling.

    There is a level of tokens by weight to which all children fill or at
    which they are full before. Children with the least capacity for their
    weight are full first, so the level lies at one place in that order: sums
    over bins of the order (a few hundred for any number of children) tell in
    which bin, sums over 4096 parts of that bin in which part, and sums of its
    equal ratios at which ratio. No child is ranked, and equal ones are added
    up before anything is ordered.
    """
    by, ratio = [*parent] or ["_all"], F.col("cap") / F.col("weight")
    rows = nodes if parent else nodes.withColumn("_all", F.lit(1))
    rows = settle(rows.withColumn("ratio", ratio), "nodes")
    at = rows.select(*by, "cap", "weight", "ratio", F.col("given").cast("double").alias("given"), F.lit(0.0).alias("c_before"), F.lit(0.0).alias("w_after"))
    for step in STEPS:
        key = F.floor(F.log2("ratio") * step)
        edge = settle(_edge(at, by, key), "edge").drop("cap", "weight")
        at = _join(at.drop("given", "c_before", "w_after").withColumn("key", key), edge, [*by, "key"]).drop("key")
    found = _edge(at, by, F.col("ratio"))
    level = found.select(*by, F.try_divide(F.col("given") - F.col("c_before"), F.col("w_after") + F.col("weight")).alias("level"))
    out = _join_left(rows, level, by)
    budget = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return out.withColumn("budget", budget).drop("level", "given", "ratio", "_all")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: dict, budget: float | Column, max_epochs: int) -> DataFrame:
    """(levels..., avail, n, budget) of each leaf (levels..., avail, n). Weights go by level and name; a name not listed weighs 1, a weight of 0 or less takes the node and what is below out."""
    leaves = leaves.filter("avail > 0")
    for level in levels:
        leaves = _weighted(leaves, level, weights.get(level, {})).filter(f"w_{level} > 0")
    leaves = leaves.withColumn("cap", F.col("avail") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).cast("double")).first()[0]
    given = None
    for depth, level in enumerate(levels):
        path, parent = list(levels[: depth + 1]), list(levels[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("weight"))
        if given is None:
            nodes = nodes.withColumn("given", F.least(F.lit(total), budget if isinstance(budget, Column) else F.lit(float(budget))))
        else:
            nodes = _join(nodes, given, parent)
        given = share(nodes, parent).select(*path, F.col("budget").alias("given"))
    return _join(leaves.select(*levels, "avail", "n"), given.withColumnRenamed("given", "budget"), levels)


def _weighted(leaves: DataFrame, level: str, by_name: dict) -> DataFrame:
    """``leaves`` with ``w_<level>``, joined from the listed names."""
    if not by_name:
        return leaves.withColumn(f"w_{level}", F.lit(1.0))
    listed = leaves.sparkSession.createDataFrame([(k, float(w)) for k, w in by_name.items()], "_name string, _w double")
    joined = leaves.join(F.broadcast(listed), F.col(level).cast("string").eqNullSafe(F.col("_name")), "left")  # a row per listed name
    return joined.withColumn(f"w_{level}", F.coalesce("_w", F.lit(1.0))).drop("_name", "_w")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    more = [F.col(f"b.`{c}`") for c in right.columns if c not in keys]
    return a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]).select("a.*", *more)


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict],
    share_of_tokens: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch that takes them, with columns ``_epoch`` and ``_tokens`` added.

    ``levels`` names the tree from the root with an expression each; null is a
    name like any other. The budget is ``share_of_tokens`` of all tokens. Rows
    without tokens (null and empty texts) are in no leaf and are not taken;
    long texts count whole. A leaf's order goes by (seeded hash, id); rows that
    tie in both, as repeated ones do, are taken together or not at all. Columns
    named ``_epoch`` or ``_tokens`` are replaced; an empty table gives an empty
    one.
    """
    names = list(levels)
    keyed = [e.alias(f"_l{i}") for i, e in enumerate(levels.values())]
    cols = [f"_l{i}" for i in range(len(names))]
    weights = {f"_l{i}": weights.get(n, {}) for i, n in enumerate(names)}
    # whether a row has tokens is cheap to tell of a text; they are counted again only of what is taken
    has = F.col("text").rlike(WORD) if tokens is None else tokens > 0
    count = (lambda: n_words(F.col("_row")["text"])) if tokens is None else (lambda: F.col("_tokens"))
    tokens = n_words(F.col("text")) if tokens is None else tokens
    narrow = settle(docs.select(F.col(id_col).alias("_id"), *keyed, tokens.cast("long").alias("_n")), "narrow")
    leaves = settle(narrow.groupBy(*cols).agg(F.sum("_n").alias("avail"), F.count("*").alias("n")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("avail"), F.lit(0))).first()[0]
    budgets = leaf_budgets(leaves, cols, weights, share_of_tokens * total, max_epochs)
    whole = F.least(F.floor((F.col("budget") + 1e-6) / F.col("avail")), F.lit(max_epochs)).cast("int")
    budgets = told = settle(budgets.withColumn("_whole", whole).withColumn("_rest", F.floor(F.col("budget") + 1e-6 - F.col("_whole") * F.col("avail"))), "budgets")

    # about as many slots as rows in a slot
    budgets = budgets.withColumn("_bits", F.least(F.ceil(F.log2(F.col("n").cast("double") + 1) / 2), F.lit(24)).cast("int"))
    place = seeded(F.col("_id"), seed, F.col("_whole"))
    slot = F.call_function("shiftright", place, F.lit(HASH_BITS) - F.col("_bits"))
    open_ = _join(narrow.filter("_n > 0"), budgets.filter("_rest > 0").drop("avail", "budget", "n"), cols).withColumn("_place", place).withColumn("_slot", slot)
    sums = open_.groupBy(*cols, "_slot", "_rest").agg(F.sum("_n").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*cols).orderBy("_slot"))
    ends = sums.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_sum")).filter("_before <= _rest AND _upto > _rest")
    last = _join(open_, ends.select(*cols, "_slot", "_before"), [*cols, "_slot"])
    # rows that tie are taken together: they are added up before they are put in order
    last = last.groupBy(*cols, "_place", "_id", "_before", "_rest").agg(F.sum("_n").alias("_n"))
    cum = F.col("_before") + F.sum("_n").over(Window.partitionBy(*cols).orderBy("_place", F.col("_id").asc_nulls_first()))
    taken = last.withColumn("_cum", cum).filter("_cum <= _rest")
    edge = taken.groupBy(*cols).agg(F.max(F.struct("_place", "_id")).alias("_edge"))
    ends = _join_left(ends.select(*cols, "_slot"), edge, cols)
    plan = settle(_join_left(budgets.drop("avail", "budget", "_rest", "n"), ends, cols), "plan")
    discard(docs.sparkSession, narrow, leaves, told)

    # the rows travel as one struct, so that no column of theirs can clash with one of these
    marked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), *keyed, has.alias("_has"), tokens.cast("long").alias("_tokens")).filter("_has").drop("_has")
    marked = _join(marked, plan, cols)
    last_epoch = F.when(F.col("_slot").isNull(), F.col("_whole") - 1).otherwise(F.col("_whole"))
    rows = marked.filter(last_epoch >= 0).select("*", F.explode(F.sequence(F.lit(0), last_epoch)).alias("_epoch"))
    within = (slot < F.col("_slot")) | ((slot == F.col("_slot")) & F.col("_edge").isNotNull() & (F.struct(place.alias("_place"), F.col("_id")) <= F.col("_edge")))
    rows = rows.filter((F.col("_epoch") < F.col("_whole")) | within)
    return rows.select(*[F.col("_row")[c].alias(c) for c in others(docs, "_epoch", "_tokens")], "_epoch", count().cast("long").alias("_tokens"))


def _join_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    more = [F.col(f"b.`{c}`") for c in right.columns if c not in keys]
    return a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "left").select("a.*", *more)


def levels() -> dict[str, Column]:
    """The tree of the documents table: four domains by the source's number, then language, then source."""
    number = F.try_to_number(F.regexp_extract(F.col("source"), r"([0-9]{1,9})$", 1), F.lit("999999999"))
    return {"domain": F.concat(F.lit("d"), F.coalesce(number.cast("long") % 4, F.lit(0)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"domain": {"d0": 0.25, "d1": 0.3, "d2": 0.25, "d3": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
SHARE, EPOCHS, SEED = 0.5, 2, 7


def query(spark, sf_dir):
    from ._shared import table

    docs = table(spark, sf_dir, "documents")
    found = mix(docs, levels(), WEIGHTS, SHARE, EPOCHS, SEED)
    return found.select("doc_id", *[e.alias(n) for n, e in levels().items()], F.col("_epoch").cast("long").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def _case(level: str) -> str:
    return f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())} ELSE 1.0 END" if level in WEIGHTS else "1.0"


def _level_sql(k: int, names: list[str]) -> str:
    path, parent = ", ".join(names[: k + 1]), ", ".join(names[:k]) or "1"
    source = f"SELECT {path}, sum(cap)::DOUBLE AS cap, any_value(({_case(names[k])})::DOUBLE) AS weight FROM leaves GROUP BY ALL"
    given = f"least((SELECT sum(cap) FROM leaves)::DOUBLE, {SHARE} * (SELECT sum(avail) FROM leaves)::DOUBLE)" if k == 0 else "g.budget"
    join = "" if k == 0 else f"JOIN b{k - 1} g ON {' AND '.join(f'n.{x} IS NOT DISTINCT FROM g.{x}' for x in names[:k])}"
    return f"""
n{k} AS (SELECT n.*, {given} AS given FROM ({source}) n {join}),
f{k} AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER w, 0))
    <= weight * (given - coalesce(sum(cap) OVER w, 0)) AS isfull
  FROM n{k} WINDOW w AS (PARTITION BY {parent} ORDER BY cap / weight, {names[k]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{k} AS (SELECT {path}, CASE WHEN isfull THEN cap ELSE
    weight * (given - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER (PARTITION BY {parent})) / sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) END AS budget
  FROM f{k})"""


_NAMES = ["domain", "lang", "source"]
ORACLE = f"""
WITH d AS (
  SELECT doc_id, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4, 0) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS avail, {EPOCHS} * sum(n)::BIGINT AS cap FROM d GROUP BY ALL HAVING sum(n) > 0),
{",".join(_level_sql(k, _NAMES) for k in range(3))},
plan AS (
  SELECT l.*, least(floor((budget + 1e-6) / avail), {EPOCHS})::BIGINT AS whole,
         floor(budget + 1e-6 - least(floor((budget + 1e-6) / avail), {EPOCHS}) * avail)::BIGINT AS rest
  FROM leaves l JOIN b2 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
r AS (
  SELECT d.*, whole, rest, unnest(range(0, whole + 1)) AS epoch
  FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source WHERE n > 0),
o AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '-{SEED}-' || epoch), 1, 15))::BIGINT AS place FROM r),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id NULLS FIRST) AS cum FROM o)
SELECT doc_id, domain, lang, source, epoch, n::BIGINT AS n_tokens FROM c WHERE epoch < whole OR (rest > 0 AND cum <= rest)
"""
