"""From raw documents to packed batches: five stages, each on all that the one before kept.

``run`` writes what a stage returns as Parquet in the folder that driver and
executors share, and the next stage reads it from there.

Every stage takes the columns of documents (others are left out, so that their
names cannot clash) and works on whole texts of any length. Null ids and rows
that repeat an id are rows like any other unless a stage says more; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _shared, language_id, line_dedup, mixing, packing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document goes where no language is known (``und``), or none leads with at least this probability.
LEAST_SCORE = 0.35
#: Near duplicates: words of a shingle, least Jaccard similarity of the shingle sets, and differing bits of the indexed 64 at most for candidates, which leave room for chance (10 at 0.8, with a deviation of 3).
SHINGLE, SIMILARITY, BITS = 5, 0.8, 18
#: Sources are mixed to this share of all tokens, each document once at most.
SHARE, EPOCHS = 0.8, 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; trained on the labelled ones outside the held-out fifth.

    Null texts and texts without letters go. Rows that repeat are answered
    alike. Of languages that tie the first by name leads. Without a labelled
    document nothing is known and all rows stay.
    """
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select(*COLUMNS), model)
    if model is not None:
        found = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones (with smaller ids) have; those of which nothing is left go.

    Null and empty texts stay. Rows that repeat an id do not meet each other,
    and rows with a null id meet none.
    """
    found = line_dedup.line_dedup(docs.select(*COLUMNS))
    found = found.filter((F.size("_deleted") == 0) | (F.trim("text") != ""))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Null texts and texts without words are one group. Of identical rows one
    stays; rows that share an id but no group with a smaller one all stay.
    Rows with a null id are compared with none: identical ones stay once.
    """
    rows = docs.select(*COLUMNS)
    named = rows.filter("doc_id IS NOT NULL")
    found = simhash.near_dedup(named, shingle=SHINGLE, tau=BITS, similarity=SIMILARITY)
    kept = named.join(found.filter("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    repeated = _shared.settle(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").distinct())
    return kept.unionByName(rows.filter("doc_id IS NULL").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix that the domain, language and source weights ask for, each once at most.

    Null and empty texts have no tokens and go; null languages and sources are
    names like others. Rows that repeat are taken together or not at all.
    """
    return mixing.mix(docs.select(*COLUMNS), mixing.levels(), mixing.WEIGHTS, SHARE, EPOCHS, mixing.SEED).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its bucket, batch and row.

    A text without words is one empty piece in no bucket. Pieces that tie in
    their seeded place go by id, piece and length.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("packing", pack_batches),
]

#: SQL cannot express the network, nor the alignment; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of the documents table."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
