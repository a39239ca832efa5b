"""Language identification by a bidirectional gated recurrent network over bytes.

Two networks of HIDDEN units read a text's UTF-8 bytes, one from either end, in stretches of STRETCH bytes that start from
a blank state. At each byte a unit moves from its old value towards a candidate by an update gate: z = sigmoid(.), c =
tanh(.), h += z * (c - h), with gate and candidate from the byte and the old h. Both states label every position with a
distribution over the languages, and a document's probabilities are the mean over its positions. Training is by
backpropagation through time in numpy on the loss of every position, with Adam, on a bounded sample of labelled text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.scratch import Scratch, small_batches

HIDDEN = 8
STRETCH = 128
#: Bounds of the training sample: documents of each language, and stretches of each document, from anywhere in it.
PER_LANGUAGE = 256
STRETCHES = 6
#: Ids of the sample that are broadcast at most; more are joined by a shuffle.
SENT = 300_000
#: Stretches that are read abreast.
ABREAST = 2048
_PAD = 256


@dataclass(frozen=True)
class Model:
    """Of each direction: embedded (2H x 257, gate rows first), recurrent (2H x H), out (L x H); bias (L)."""

    langs: list[str]
    embedded: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray


def stretches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each stretch, and its document."""
    size = np.diff(at)
    many = -(-size // STRETCH)
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = at[doc] + nth * STRETCH
    return start, np.minimum(STRETCH, at[doc + 1] - start), doc


def _bytes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """STRETCH x n byte numbers, with _PAD behind a stretch's end."""
    step = np.arange(STRETCH)[:, None]
    x = raw[np.minimum(start + step, len(raw) - 1)].astype(np.int16)
    x[step >= size] = _PAD
    return x


def _states(e: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """h after each step (T x H x n), and if keep the gate and candidate values (T x 2H x n)."""
    steps, n = x.shape
    hidden = u.shape[1]
    e = e.copy()
    e[:hidden] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
    u = np.concatenate([u[:hidden] * 0.5, u[hidden:]]).astype(e.dtype)
    h = np.zeros((hidden, n), e.dtype)
    hs, gs = np.empty((steps, hidden, n), e.dtype), np.empty((steps, 2 * hidden, n), e.dtype) if keep else None
    g, b = np.empty((2 * hidden, n), e.dtype), np.empty((2 * hidden, n), e.dtype)
    for t in range(steps):
        np.take(e, x[t], axis=1, out=b, mode="clip")
        np.matmul(u, h, out=g)
        g += b
        np.tanh(g, out=g)
        z, c = g[:hidden], g[hidden:]
        z += 1
        z *= 0.5
        if keep:
            gs[t] = g
        c -= h
        c *= z
        h += c
        hs[t] = h
    return hs, gs


def _softmax(a: np.ndarray) -> np.ndarray:
    """Over axis 1, in place."""
    a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=1, keepdims=True)
    return a


def positions(m: Model, x: np.ndarray) -> np.ndarray:
    """T x L x n probabilities."""
    ahead, _ = _states(m.embedded[0], m.recurrent[0], x, False)
    a = np.matmul(m.out[0], ahead)
    back, _ = _states(m.embedded[1], m.recurrent[1], x[::-1], False)
    a += np.matmul(m.out[1], back)[::-1]
    a += m.bias[:, None]
    return _softmax(a)


def _direction_gradient(u: np.ndarray, x: np.ndarray, hs: np.ndarray, gs: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the embedded bytes and the recurrent weights."""
    steps, hidden, n = hs.shape
    de, du, dh = np.zeros((257, 2 * hidden)), np.zeros_like(u), np.zeros((hidden, n), hs.dtype)
    da = np.empty((steps, 2 * hidden, n), hs.dtype)
    for t in range(steps - 1, -1, -1):
        before = hs[t - 1] if t else np.zeros((hidden, n), hs.dtype)
        z, c = gs[t, :hidden], gs[t, hidden:]
        dh = dh + dh_out[t]
        da[t, :hidden] = dh * (c - before) * z * (1 - z)
        da[t, hidden:] = dh * z * (1 - c * c)
        dh = dh * (1 - z) + u.T @ da[t]
        du += da[t] @ before.T
    flat, rows = x.ravel(), np.moveaxis(da, 1, 0).reshape(2 * hidden, -1)
    for k in range(2 * hidden):
        de[:, k] = np.bincount(flat, rows[k], 257)
    return de.T.astype(hs.dtype), du


def gradient(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradients: embedded, recurrent, out by direction, then bias."""
    sides = (x, x[::-1])
    made = [_states(e, u, s, True) for e, u, s in zip(m.embedded, m.recurrent, sides, strict=True)]
    a = np.matmul(m.out[0], made[0][0]) + np.matmul(m.out[1], made[1][0])[::-1] + m.bias[:, None]
    p = _softmax(a)
    there = (x != _PAD)[:, None, :]
    total = there.sum()
    cols = np.arange(x.shape[1])
    loss = -(np.log(np.maximum(p[:, y, cols], 1e-12)) * there[:, 0]).sum() / total
    p[:, y, cols] -= 1
    p *= there / total
    grads = [[], [], []]
    for k, (hs, gs) in enumerate(made):
        d = p if k == 0 else p[::-1]
        de, du = _direction_gradient(m.recurrent[k], sides[k], hs, gs, np.matmul(m.out[k].T, d))
        de[:, _PAD] = 0
        for g, v in zip(grads, (de, du, np.einsum("tln,thn->lh", d, hs, optimize=True)), strict=True):
            g.append(v)
    return float(loss), [*grads[0], *grads[1], *grads[2], p.sum(axis=(0, 2))]


def _blank(langs: list[str], dtype, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    embedded = [rng.normal(0, 0.3, (2 * HIDDEN, 257)).astype(dtype) for _ in range(2)]
    for e in embedded:
        e[:HIDDEN] -= 1  # gates start mostly shut, so that what was read lasts
        e[:HIDDEN, _PAD], e[HIDDEN:, _PAD] = -40, 0  # padding moves nothing
    return Model(langs, embedded, [rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(dtype) for _ in range(2)], [rng.normal(0, 0.3, (len(langs), HIDDEN)).astype(dtype) for _ in range(2)], np.zeros(len(langs), dtype))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, place, size, bytes: at most STRETCHES stretches of each of batches of doc_id, lang, text, drawn by the text's CRC."""
    for batch in batches:
        langs, out = batch.column(1).to_pylist(), [[], [], [], []]
        raw, at = kernel.utf8(batch.column(2))
        start, size, doc = stretches(raw, at)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        for k, lang in enumerate(langs):
            own = np.arange(ends[k], ends[k + 1])
            seed = zlib.crc32(raw[at[k] : at[k + 1]].tobytes())
            if len(own) > STRETCHES:
                own = np.sort(np.random.default_rng(seed).choice(own, STRETCHES, replace=False))
            for x in own:
                for column, v in zip(out, (lang, seed, int(size[x]), raw[start[x] : start[x] + size[x]].tobytes()), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["lang", "place", "size", "bytes"])


def fit(pieces: list[tuple[str, bytes]], rounds: int = 260, batch: int = 384, seed: int = 3) -> Model:
    """Adam over stretches with their languages, each language as often as any other."""
    names = sorted({lang for lang, _ in pieces})
    m = _blank(names, np.float32, seed)
    if len(names) < 2:
        return m
    rng = np.random.default_rng(seed)
    raw = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    size = np.array([len(p) for _, p in pieces], np.int64)
    start = np.cumsum(size) - size
    y = np.array([names.index(lang) for lang, _ in pieces], np.int64)
    pools = [np.flatnonzero(y == k) for k in range(len(names))]
    params = [*m.embedded, *m.recurrent, *m.out, m.bias]
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    for r in range(1, rounds + 1):
        own = np.concatenate([rng.choice(p, -(-batch // len(pools))) for p in pools])
        _, grads = gradient(m, _bytes(raw, start[own], size[own]), y[own])
        rate = 0.02 * min(1, 2 * (1 - r / (rounds + 1)))
        for v, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= (rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)).astype(v.dtype)
    return m


def train(spark: SparkSession, docs: DataFrame, allowed: Column) -> Model | None:
    """Fits on at most PER_LANGUAGE documents of each language and STRETCHES stretches of each; None without labelled text.

    A language's documents are dealt into PER_LANGUAGE groups by the hash of doc_id, and each group gives the one whose
    second hash is least. Stretches are drawn from whole texts on the executors, and the driver has their bytes alone. Every
    language of allowed rows is learnt. Null ids, texts and languages do not count; a doc_id with several rows gives
    stretches of each.
    """
    rows = docs.select("doc_id", "lang", "text").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(allowed)
    groups = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(PER_LANGUAGE)).alias("g"))
    tmp = Scratch(spark, "langid")
    ids = tmp.save(groups.agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id")).select("doc_id").distinct(), "ids")
    # few enough to be sent to all tasks, unless there are over a thousand languages
    ids_ = F.broadcast(ids) if ids.count() <= SENT else ids
    sample = small_batches(rows).join(ids_, "doc_id", "left_semi")
    got = sample.mapInArrow(_pieces, "lang string, place bigint, size bigint, bytes binary").collect()
    tmp.drop(ids)
    got = sorted({(r["lang"], r["place"], bytes(r["bytes"])) for r in got})
    if not got:
        return None
    return fit([(lang, piece) for lang, _, piece in got])


def _predict(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = kernel.utf8(batch.column(1))
            n = batch.num_rows
            total = np.zeros((n, len(m.langs)))
            start, size, doc = stretches(raw, at)
            by_size = np.argsort(-size, kind="stable")
            for k in range(0, len(by_size), ABREAST):
                own = by_size[k : k + ABREAST]
                x = _bytes(raw, start[own], size[own])[: size[own].max()]
                p = positions(m, x)
                p *= (x != _PAD)[:, None, :]
                p = p.sum(axis=0)
                for lang in range(len(m.langs)):
                    total[:, lang] += np.bincount(doc[own], p[lang], n)
            total /= np.maximum(np.diff(at), 1)[:, None]
            best = total.argmax(axis=1)
            score = np.clip(total[np.arange(n), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.langs[b] for b in best], pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, m: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of docs.

    Texts that are null or without a letter are `und` with score 0, and so is everything without a model. Of other
    columns, none is read; an empty table gives no rows.
    """
    lettered = F.col("text").rlike(r"\p{L}")
    rows = small_batches(docs).select(F.struct("doc_id", F.coalesce(lettered, F.lit(False)).alias("ok")).alias("row"), F.when(lettered, F.col("text")).alias("text"))
    if m is None:
        return rows.select("row.doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    made = rows.mapInArrow(_predict(m), "row struct<doc_id:bigint,ok:boolean>, lang_pred string, score double")
    return made.select("row.doc_id", F.when(F.col("row.ok"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("row.ok"), F.col("score")).otherwise(0.0).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id takes no part in training; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out documents are not looked at in training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(spark, docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
