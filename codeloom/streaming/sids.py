"""Streams of item vectors: code assignment, and mini-batch k-means with replay-safe state."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kmeans import Codebook, minibatch_step
from ..operators.residual import assign_rq


def assign_stream(sdf: DataFrame, key: str, col: str, codebooks: list[np.ndarray], normalize: bool = True) -> DataFrame:
    """A stateless stream of (key, sid, ...), for append mode."""
    return assign_rq(sdf, key, col, codebooks, normalize)


def read_state(spark: SparkSession, path: str, batch_id: int) -> Codebook | None:
    """The state after a batch; None if that batch's state was not written to its end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
        return None
    rows = spark.read.parquet(folder.toString()).orderBy("code").collect()  # K rows
    return Codebook(np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows]))


def write_state(spark: SparkSession, path: str, batch_id: int, state: Codebook) -> None:
    rows = [(k, c.tolist(), float(n)) for k, (c, n) in enumerate(zip(state.centroids, state.counts, strict=True))]
    spark.createDataFrame(rows, "code int, centroid array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def drop_states(spark: SparkSession, path: str, before: int) -> None:
    """Delete the states of batches before this one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < before:
            files.delete(status.getPath(), True)


def fit_batch(df: DataFrame, batch_id: int, col: str, start: Codebook, state_path: str) -> Codebook:
    """One step from the state of the batch before (``start`` for the first); a batch that already has its state is skipped, so a replay changes nothing.

    The stream replays at most the batch that it had not committed, which
    needs the state before it: so the last two states are kept, and older ones
    deleted once the new one is whole. A batch whose predecessor has none is an error.
    """
    spark = df.sparkSession
    done = read_state(spark, state_path, batch_id)
    if done is not None:
        return done
    before = read_state(spark, state_path, batch_id - 1) if batch_id > 0 else start
    if before is None:
        raise RuntimeError(f"no state of batch {batch_id - 1} under {state_path}")
    state = minibatch_step(df.filter(F.col(col).isNotNull()), col, before)
    write_state(spark, state_path, batch_id, state)
    drop_states(spark, state_path, batch_id - 1)
    return state


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint gives it for life; a new checkpoint has a new one."""
    return json.loads("".join(r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def fit_stream(sdf: DataFrame, col: str, start: Codebook, state_path: str, checkpoint: str):
    """A started query that moves the codebook by each micro-batch.

    Its states are under ``state_path`` and the stream's own id (its query's
    ``id``), so a stream that begins anew with another checkpoint finds no
    states of an earlier one.
    """
    spark = sdf.sparkSession

    def step(df: DataFrame, batch_id: int) -> None:
        fit_batch(df, batch_id, col, start, f"{state_path}/{stream_id(spark, checkpoint)}")

    return sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
