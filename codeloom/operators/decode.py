"""Beam decoding from a table of logits (user, prefix, code, logit), under valid prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle


def prefix_index(sids: DataFrame, hierarchies: int) -> DataFrame:
    """(depth, prefix, code): the codes that may follow each prefix of a known tuple, once each."""
    steps = [F.struct(F.lit(h).alias("depth"), F.slice("sid", 1, h).alias("prefix"), F.col("sid")[h].alias("code")) for h in range(hierarchies)]
    rows = sids.filter(F.size("sid") >= hierarchies).select(F.explode(F.array(*steps)).alias("x")).select("x.*")
    return rows.distinct()


def valid_logits(logits: DataFrame, hierarchies: int, sids: DataFrame | None = None) -> DataFrame:
    """The logits that decoding may read, with their ``depth``, computed once as a table in parts by depth: each step reads its own part."""
    rows = logits.withColumn("depth", F.size("prefix")).filter(F.col("depth") < hierarchies)
    if sids is not None:
        rows = rows.join(prefix_index(sids, hierarchies), ["depth", "prefix", "code"], "left_semi")
    return settle(rows.select("user_id", "prefix", "code", "logit", "depth"), "logits", "depth")


def _grown(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each user's next codes (user_id, prefix, code, logit, probability of the prefix)."""
    beam = Window.partitionBy("user_id", "prefix")
    scored = rows.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(beam))).withColumn("_p", F.col("probability") * F.col("_e") / F.sum("_e").over(beam))
    scored = scored.withColumn("_next", F.concat("prefix", F.array("code")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("_p", 12)), "_next"))
    return scored.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("user_id", F.col("_next").alias("prefix"), F.col("_p").alias("probability"))


def _follow(beams: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the users' beams, with the beam's probability. Each user's beams are one row of at most k, so that the join, the softmax and the ranking are all dealt by user alone."""
    held = beams.groupBy("user_id").agg(F.collect_list(F.struct("prefix", "probability")).alias("_beams"))
    found = rows.join(held, "user_id").withColumn("probability", F.expr("get(filter(_beams, b -> b.prefix = prefix), 0).probability"))
    return found.filter("probability IS NOT NULL").drop("_beams")


def beam_step(beams: DataFrame, logits: DataFrame, k: int, sids: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """(user_id, prefix, probability): each beam's valid next codes by softmax, times the beam's probability, the best ``k`` per user, ties to the smaller prefix. Beams have ``depth`` codes; only logits and valid prefixes of that depth are read."""
    rows = logits.filter(F.size("prefix") == depth)
    if sids is not None:
        known = prefix_index(sids, depth + 1).filter(F.col("depth") == depth).select("prefix", "code")
        rows = rows.join(known, ["prefix", "code"], "left_semi")
    return _grown(_follow(beams, rows.select("user_id", "prefix", "code", "logit")), k)


def beam_decode(logits: DataFrame, hierarchies: int, k: int = 10, sids: DataFrame | None = None) -> DataFrame:
    """(user_id, rank, sid, probability) after ``hierarchies`` steps. A user without valid codes has fewer than ``k`` rows. The logits are computed once."""
    table = valid_logits(logits, hierarchies, sids)
    # dealt by user once a depth: neither the join with the beams nor softmax and ranking need a further exchange
    part = lambda depth: table.filter(F.col("depth") == depth).drop("depth").repartition("user_id")
    beams = _grown(part(0).withColumn("probability", F.lit(1.0)), k)
    for depth in range(1, hierarchies):
        beams = _grown(_follow(beams, part(depth)), k)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("probability", 12)), "prefix"))
    return beams.select("user_id", rank.alias("rank"), F.col("prefix").alias("sid"), "probability")
