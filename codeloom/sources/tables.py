"""Sources and sinks: pruned reads, embedding tables, mappings, keyed predictions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, glob: str | None = None, limit_files: int | None = None) -> DataFrame:
    """Parquet under ``path``, only ``columns`` (all if none are named), only files that match ``glob``, of these only the first ``limit_files`` by name if given."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    df = reader.parquet(path)
    if limit_files is not None:
        df = spark.read.schema(df.schema).parquet(*sorted(df.inputFiles())[:limit_files])
    return df.select(*columns) if columns else df


def load_embeddings(df: DataFrame, id_col: str, vec_col: str, check: bool = True) -> DataFrame:
    """(item_id, embedding); an error unless ids are unique and all vectors have one width. The check reads all ids and widths once; leave it out for a table that has passed it."""
    out = df.select(F.col(id_col).cast("long").alias("item_id"), F.col(vec_col).alias("embedding"))
    if not check:
        return out
    seen = out.groupBy("item_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    n, lo, hi = seen.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if n is not None and n > 1:
        raise ValueError("an item id occurs more than once")
    if lo != hi:
        raise ValueError(f"vectors have widths {lo} to {hi}")
    return out


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(category, index) from files that hold one JSON object each."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("category", "index"))


def write_predictions(df: DataFrame, path: str, key: str, value: str, rows_per_file: int = 100_000) -> None:
    """Keyed rows as Parquet files of at most ``rows_per_file`` rows."""
    df.select(key, value).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def merge_keyed(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(position, value) dense from 0 to the number of rows less one: missing positions are zero vectors, of a repeated key the row last by ``order`` wins, a key outside the range is an error."""
    n, least, most, width = df.agg(F.count("*"), F.min(key), F.max(key), F.max(F.size(value))).first()
    if n and (least < 0 or most >= n):
        raise ValueError(f"keys must lie from 0 to {n - 1}, found {least} to {most}")
    last = df.groupBy(F.col(key).alias("position")).agg(F.max_by(value, order).alias("value"))
    zeros = F.array_repeat(F.lit(0.0), max(width or 0, 0))
    return df.sparkSession.range(n).withColumnRenamed("id", "position").join(last, "position", "left").select("position", F.coalesce(F.col("value").cast("array<double>"), zeros).alias("value"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where none is set and one process does everything (tests) a temporary
    folder becomes it; a cluster without one, also a local one, is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, kind: str, *by: str) -> DataFrame:
    """``df`` computed once, as a table in the shared folder, in parts by the columns ``by``; later plans read it from there, also after losing executors."""
    folder = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete a settled table that no plan needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A full, repeatable shuffle: rows in the order of a seeded digest of their key."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key)


def shuffle_places(df: DataFrame, key: str, seed: int, shards: int = 4096) -> DataFrame:
    """(key, place): the places, from 1, that ``shuffle_rows`` gives. Digests are evenly spread, so ranks within ranges of them and the ranges' sizes tell the places, no task holding more than a range."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.select(key, digest.alias("_d")).withColumn("_r", (F.conv(F.substring("_d", 1, 8), 16, 10).cast("long") * shards / (1 << 32)).cast("int"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", before.alias("_before"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_d", key))
    return rows.withColumn("_rank", rank).join(F.broadcast(sizes), "_r").select(key, (F.col("_rank") + F.col("_before")).cast("long").alias("place"))
