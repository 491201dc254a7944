"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled rows; it labels every byte position, and a
document's probabilities are the mean of those of its letters. Whole texts are
read in windows, many at a time, one column each.

Gates are clipped lines instead of logistic curves and the candidate state is
x / (1 + |x|) instead of tanh: the same cell, at a third of the time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import others

#: Width of the state in each direction; bytes of a window when labelling; windows side by side.
HIDDEN, WINDOW, SIDE = 8, 256, 1024
#: The bound of the training sample: documents of each language, windows of each, bytes of a window.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_BYTES = 500, 3, 96
STEPS, BATCH, RATE = 260, 128, 0.02
UNKNOWN = "und"

IS_ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
IS_TEXT = IS_ASCII_LETTER | (np.arange(256) >= 0x80)


@dataclass
class Model:
    """``tables`` (2, 3H, 256), ``recurrent`` (2, 3H, H), ``head`` (L, 2H), ``bias`` (L, 1); ``langs`` names the L rows."""

    langs: list[str]
    tables: np.ndarray
    recurrent: np.ndarray
    head: np.ndarray
    bias: np.ndarray


def _forward(table, recurrent, x, keep=False, inside=None):
    """States (T, H, B) after each byte of ``x`` (T, B), and what the backward pass needs. Outside ``inside`` (T, B) the state stays zero."""
    steps, b = x.shape
    h3, width = recurrent.shape
    h = np.zeros((width, b), np.float32)
    out = np.empty((steps, width, b), np.float32)
    a, g, n, low = np.empty((h3, b), np.float32), np.empty((h3, b), np.float32), np.empty((width, b), np.float32), np.empty((width, b), np.float32)
    saved = []
    gates = slice(0, 2 * width)
    for t in range(steps):
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(recurrent, h, out=g)
        zr = a[gates]
        zr += g[gates]
        raw = zr.copy() if keep else None
        np.clip(zr, 0.0, 1.0, out=zr)
        np.multiply(zr[width:], g[2 * width :], out=n)
        n += a[2 * width :]
        np.abs(n, out=low)
        low += 1.0
        n /= low
        if keep:
            saved.append((h.copy(), raw, zr.copy(), g[2 * width :].copy(), n.copy()))
        h -= n
        h *= zr[:width]
        h += n
        if inside is not None:
            h *= inside[t]
        out[t] = h
    return out, saved


def _backward(recurrent, saved, d_out):
    """Gradients of the table's gathered columns (T, 3H, B) and of the recurrent weights."""
    h3, width = recurrent.shape
    d_rec = np.zeros_like(recurrent)
    d_x = np.empty((len(saved), h3, d_out.shape[2]), np.float32)
    dh = np.zeros_like(d_out[0])
    for t in range(len(saved) - 1, -1, -1):
        h, raw, zr, un, n = saved[t]
        dh = dh + d_out[t]
        z, r = zr[:width], zr[width:]
        d_n = dh * (1 - z) * (1 - np.abs(n)) ** 2
        inside = (raw > 0) & (raw < 1)
        d_z, d_r = dh * (h - n) * inside[:width], d_n * un * inside[width:]
        d_x[t] = np.concatenate([d_z, d_r, d_n])
        d_g = np.concatenate([d_z, d_r, d_n * r])
        d_rec += d_g @ h.T
        dh = dh * z + recurrent.T @ d_g
    return d_x, d_rec


def _probabilities(logits):
    p = np.exp(logits - logits.max(0))
    return p / p.sum(0)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 5, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, hidden: int = HIDDEN) -> Model:
    """Fit on ``windows`` (N, T) of bytes and their language numbers, each language equally often; Adam on the mean cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    f, n_lang = np.float32, len(langs)
    tables = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(f)
    tables[:, : 2 * hidden] += 0.5
    params = [tables, rng.normal(0, 0.25, (2, 3 * hidden, hidden)).astype(f), rng.normal(0, 0.3, (n_lang, 2 * hidden)).astype(f), np.zeros((n_lang, 1), f)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    of = [np.flatnonzero(labels == k) for k in range(n_lang)]
    for step in range(1, steps + 1):
        y = np.arange(batch) % n_lang
        x = windows[[rng.choice(of[k]) for k in y]].T.astype(np.intp)
        tables, recurrent, head, bias = params
        ahead, saved_a = _forward(tables[0], recurrent[0], x, True)
        back, saved_b = _forward(tables[1], recurrent[1], x[::-1], True)
        state = np.concatenate([ahead, back[::-1]], axis=1)
        p = np.stack([_probabilities(head @ s + bias) for s in state])
        p[:, y, np.arange(batch)] -= 1
        p /= p.shape[0] * batch
        d_head = np.einsum("tlb,thb->lh", p, state)
        d_state = np.einsum("tlb,lh->thb", p, head)
        d_tables, d_recurrent = np.zeros_like(tables), np.zeros_like(recurrent)
        for k, (saved, d, seen) in enumerate(((saved_a, d_state[:, :hidden], x), (saved_b, d_state[::-1, hidden:], x[::-1]))):
            d_x, d_recurrent[k] = _backward(recurrent[k], saved, d)
            flat, columns = seen.ravel(), d_x.transpose(1, 0, 2).reshape(3 * hidden, -1)
            d_tables[k] = np.stack([np.bincount(flat, c, 256) for c in columns])
        slow = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for q, g, (m, v) in zip(params, (d_tables, d_recurrent, d_head, p.sum((0, 2))[:, None]), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f)
    return Model(langs, *params)


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes end to end, and of each window its document, start and length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // size)
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(b"".join(texts), np.uint8), doc, begin[doc] + k * size, np.minimum(size, lengths[doc] - k * size)


def label(model: Model, texts: list[bytes], size: int = WINDOW, side: int = SIDE, positions: bool = False):
    """Summed letter probabilities (docs, L) and letter counts; with ``positions`` also each byte's label, as one array over all texts."""
    data, doc, start, length = _windows(texts, size)
    n_lang = len(model.langs)
    total, letters = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
    labels = np.zeros(len(data), np.int16) if positions else None
    order = np.argsort(-length, kind="stable")
    width = model.recurrent.shape[2]
    for a in range(0, len(order), side):
        some = order[a : a + side]
        steps = int(length[some[0]])
        at = start[some][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[some][None, :]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], 32)
        seen = IS_TEXT[x] & inside
        x = x.astype(np.intp)
        ahead, _ = _forward(model.tables[0], model.recurrent[0], x)
        # a window shorter than its neighbours begins at its own last byte, from a zero state
        back, _ = _forward(model.tables[1], model.recurrent[1], x[::-1], inside=None if inside.all() else inside[::-1])
        pooled = np.zeros((n_lang, len(some)), np.float64)
        weight = seen.astype(np.float32)
        for t in range(steps):
            p = model.head[:, :width] @ ahead[t]
            p += model.head[:, width:] @ back[steps - 1 - t]
            p += model.bias
            p -= p.max(0)
            np.exp(p, out=p)
            if positions:
                labels[at[t][inside[t]]] = p.argmax(0)[inside[t]]
            p *= weight[t] / p.sum(0)
            pooled += p
        np.add.at(total, doc[some], pooled.T)
        np.add.at(letters, doc[some], seen.sum(0))
    return total, letters, labels


def has_letter(text: bytes) -> bool:
    return bool(IS_ASCII_LETTER[np.frombuffer(text, np.uint8)].any()) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def training_windows(rows: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = TRAIN_DOCS, each: int = TRAIN_WINDOWS, size: int = TRAIN_BYTES) -> pd.DataFrame:
    """(lang, window): of at most ``docs`` documents per language, those with the smallest hashes of id and then text, ``each`` windows from anywhere in the text. Identical rows count once."""
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).cast("binary").alias("_text"), F.xxhash64(F.col(id_col), F.lit(17)).alias("_h"))
    rows = rows.withColumn("_t", F.xxhash64("_text"))
    # the smallest hashes of every language: of each salt first, so that no language is ranked in one task
    salted = Window.partitionBy("_lang", "_salt").orderBy("_h", "_t")
    some = rows.select("_lang", "_h", "_t").distinct()
    some = some.withColumn("_salt", F.pmod(F.hash("_h", "_t"), F.lit(16))).withColumn("_rank", F.row_number().over(salted)).filter(F.col("_rank") <= docs)
    last = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_t"))).filter(F.col("_rank") <= docs)
    last = last.groupBy("_lang").agg(F.max(F.struct("_h", "_t")).alias("_last"))  # a row per language
    sample = rows.join(F.broadcast(last), "_lang").filter(F.struct("_h", "_t") <= F.col("_last")).dropDuplicates(["_lang", "_h", "_t"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, lang, text in zip(b["_id"], b["_lang"], b["_text"], strict=True):
                rng = np.random.default_rng(zlib.crc32(str(i).encode()))
                for _ in range(each):
                    k = int(rng.integers(0, max(1, len(text) - size + 1)))
                    out.append((lang, bytes(text[k : k + size]).ljust(size)))
            yield pd.DataFrame(out, columns=["lang", "window"])

    found = sample.mapInPandas(cut, "lang string, window binary").toPandas()
    return found.sort_values(["lang", "window"], kind="stable").reset_index(drop=True)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model | None:
    """The model of the labelled ``rows``; None where there are none. Null texts or labels are left out."""
    usable = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    found = training_windows(usable, id_col, text_col, lang_col)
    if found.empty:
        return None
    langs = sorted(found["lang"].unique())
    windows = np.stack([np.frombuffer(bytes(w), np.uint8) for w in found["window"]])
    return train(windows, found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(), langs, **options)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", segments: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, unless ``keep_text``) with ``lang_pred`` and ``score`` added (whole texts); with ``segments`` also ``lang_runs``, the labels of all byte positions as runs (start, end, lang).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when there is no model. Ties go to the language that sorts first.
    Texts of any length are read whole, in windows. Each row is answered for
    itself, repeated ones alike; an empty table gives an empty one. Columns of
    ``docs`` that bear a result's name are replaced.
    """
    runs_type = "array<struct<start:int,end:int,lang:string>>"
    kept = docs.select(*[F.col(f"`{c}`") for c in others(docs, "lang_pred", "score", *["lang_runs"] * segments) if keep_text or c != text_col])
    if model is None:
        out = kept.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
        return out.withColumn("lang_runs", F.array().cast(runs_type)) if segments else out
    langs = model.langs
    sent = kept if text_col in kept.columns else docs.select(*kept.columns, text_col)
    at = sent.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            known = np.array([has_letter(t) for t in texts], bool)
            total, letters, labels = label(model, texts, positions=segments)
            p = total / np.maximum(letters, 1)[:, None]
            best = p.argmax(1)
            columns = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            names = [c for k, c in enumerate(batch.schema.names) if keep_text or k != at]
            columns.append(pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string()))
            columns.append(pa.array(np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0), pa.float64()))
            names += ["lang_pred", "score"]
            if segments:
                columns.append(_runs(texts, labels, langs))
                names.append("lang_runs")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"] + [f"lang_runs {runs_type}"] * segments)
    return sent.mapInArrow(run, schema)


def _runs(texts, labels, langs) -> pa.Array:
    out, at = [], 0
    for t in texts:
        own = labels[at : at + len(t)]
        at += len(t)
        cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(t)] if len(t) else []
        out.append([{"start": a, "end": b, "lang": langs[own[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def query(spark, sf_dir):
    from ._shared import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")
