"""Periodic runs of words, found with bit-parallel lags.

The words of a text are numbered and the numbers' bits laid out as big
integers, one per bit, a bit per word. For a lag, each plane is XORed with
itself shifted by it and the results are ORed: a zero is a word that equals
the one a lag further on. ANDing the zeros with themselves at doubling shifts
leaves the starts of stretches long enough for a run. A text is one row's
work, so nothing is shuffled and a lost task begins again with its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
#: Texts of more words test a lag at spread places first, ``PROBES`` of which any run would hold.
LONG, PROBES = 8192, 8


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane b as an integer whose bit i is bit b of ``ids[i]``."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1 != 0, bitorder="little").tobytes(), "little") for b in range(bits)]


def set_bits(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes(-(-x.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(ok: int, need: int) -> int:
    """The places from which ``need`` set bits follow each other."""
    width = 1
    while ok and width < need:
        step = min(width, need - width)
        ok &= ok >> step
        width += step
    return ok


def may_hold(ids: np.ndarray, lag: int, need: int) -> bool:
    """False only if no ``need`` words in a row equal those ``lag`` later: among them lie ``PROBES`` multiples of the stride, one after the other, all of which would be equal."""
    stride = need // PROBES
    if not stride:
        return True
    same = ids[:-lag:stride] == ids[lag::stride]
    for step in (1, 2, 4):
        if not same.any():
            return False
        same = same[:-step] & same[step:]
    return bool(same.any())


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: stretches of ``least`` numbers and ``times`` periods or more that cannot be longer and have no smaller period.

    A stretch of three periods whose smallest period is another has that
    period as a divisor (Fine and Wilf) and the same ends, and is found there
    first.
    """
    n = len(ids)
    planes, whole, found = bit_planes(ids), (1 << n) - 1, {}
    for lag in range(1, n // times + 1 if n >= least else 1):
        need = max(least - lag, (times - 1) * lag)
        if n > LONG and not may_hold(ids, lag, need):
            continue
        valid, differ = whole >> lag, 0
        for k, plane in enumerate(planes):
            differ |= plane ^ (plane >> lag)
            # four planes tell most words apart: often nothing is left to look at
            if k == 3 and not stretches(valid & ~differ, need):
                break
        else:
            held = stretches(valid & ~differ, need)
            if held:
                for a, b in zip(set_bits(held & ~(held << 1)).tolist(), set_bits(held & ~(held >> 1)).tolist(), strict=True):
                    found.setdefault((a, b - a + need + lag), lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def drawn_from(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word is taken from, in the documents into which a period is planted by the digest of their id; None elsewhere, and for null ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, source: Callable | None = None, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, strongest, collapsed): every periodic run of words as (start, length, period), that of the greatest length by period (of equal ones the first, then of the smallest period; null without runs), and the words joined by spaces without those that a run repeats.

    Words are what spaces and the controls 9 to 13 part. A word goes if it
    lies after the first period of any run. ``source(id, n)`` may say from
    which of the n words each is taken. Null and empty texts have no words; texts of
    any length are searched whole, every lag of them; null ids and repeated
    rows are rows like any other; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = "struct<start:bigint,length:bigint,period:bigint>"

    def one(doc_id, text):
        words = text.split() if text else []  # bytes: parted at 32 and 9 to 13
        number: dict = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        taken = source(doc_id, len(words)) if source else None
        if taken is not None:
            ids, words = ids[taken], [words[k] for k in taken.tolist()]
        runs = find_runs(ids, least, times)
        gone = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist() if runs else range(len(words))
        return runs, max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None), b" ".join([words[k] for k in kept])

    def run(batches):
        fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        for b in batches:
            found = [one(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = [pa.array([[named(r) for r in x[0]] for x in found], pa.list_(fields)), pa.array([named(x[1]) for x in found], fields), pa.array([x[2] for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, runs array<{run_type}>, strongest {run_type}, collapsed binary")
    return found.select(F.col("id").alias(id_col), "runs", "strongest", F.col("collapsed").cast("string").alias("collapsed"))


def listed(runs: Column | str) -> Column:
    """A line ``start,length,period`` of each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def query(spark, sf_dir):
    found = periodic_runs(table(spark, sf_dir, "documents"), drawn_from)
    top = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, milli, F.sha2(listed("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
