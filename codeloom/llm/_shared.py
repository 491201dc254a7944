"""What several operators use: the shared folder, and ASCII lower-casing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str = "settled") -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder; later plans read it from there."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete settled tables that no plan needs any more: what was made of them is settled itself."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = hadoop(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those of these names, in either case."""
    return [c for c in df.columns if c.lower() not in names]


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, everything else unchanged; texts without other letters take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
