"""Toxicity by multiple-instance learning: sentence scores, combined by a noisy-or, are trained from document labels.

A sentence's score is the logistic of a bias and its distinct features' weights (hashed words and their first four and
five bytes). A document is toxic unless none of its sentences is, 1 - (1 - leak) * prod(1 - score); the leak takes what no
sentence explains, so that label noise does not seep into the sentences and long texts are not toxic for their length.
The same sentence scores locate what offends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.scratch import small_batches

#: Feature slots.
SLOTS = 1 << 18
#: Rounds of the fit: of 200, 400 and 800, this had the fewest errors in four-fold cross-validation on the training rows of a small table.
ROUNDS = 200
#: Bound of the training sample: labelled documents of each class. Whole texts of them are read, on the executors.
PER_CLASS = 3000
#: A feature counts if this many toxic training documents have it.
LEAST_DOCS = 4
#: ... and if it is in more toxic than other ones by this many standard errors. Weights start from its log odds. Both numbers
#: had the fewest errors of six settings in four-fold cross-validation on the training rows of a small table.
SURPRISE = 5.0
#: ... and this many times as often in them: of 1.5, 3 and 6, none had fewer errors in the same cross-validation.
LIFT = 3.0
THRESHOLD = 0.3
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    """Weights, the sentence bias and the leak."""

    weights: np.ndarray
    bias: float
    leak: float


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of documents: i, j, slots (words x 3), each word's sentence, each sentence's document less i, start and end."""
    for i, j, s, e, h, d in kernel.words(raw, at, kernel.ALNUM):
        if not len(h):
            none = np.zeros(0, np.int64)
            yield i, j, np.zeros((0, 3), np.int64), none, none, none, none
            continue
        lo = int(at[i])
        stops = np.cumsum(_STOPS[raw[lo : int(at[j])]], dtype=np.int32)[s - lo]
        new = np.append(True, (stops[1:] != stops[:-1]) | (d[1:] != d[:-1]))
        own = np.cumsum(new) - 1
        heads = np.zeros((2, len(h)), np.uint64)
        size, top = e - s, len(raw) - 1
        for k in range(5):
            byte = np.where(size > k, kernel.LOWER[raw[np.minimum(s + k, top)]], 0).astype(np.uint64) << np.uint64(8 * k)
            heads[1] |= byte
            if k < 4:
                heads[0] |= byte
        slots = np.empty((len(h), 3), np.int64)
        slots[:, 0] = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        slots[:, 1:] = (kernel.mix(heads + np.array([[1 << 60], [2 << 60]], np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64).T
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        yield i, j, slots, own, d[first], s[first], e[last]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, slot, n: of batches of toxic, text, documents of a class that have a feature, for a task."""
    there = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        labels = np.asarray(batch.column(0))
        for i, j, f, own, of, _, _ in features(*kernel.utf8(batch.column(1))):
            if len(of):
                pairs = np.unique(np.repeat(of[own], 3) * SLOTS + f.ravel())  # a document's distinct features
                np.add.at(there, (labels[i:j][pairs // SLOTS], pairs % SLOTS), 1)
    value, slot = np.nonzero(there)
    yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(there[value, slot])], ["toxic", "slot", "n"])


def _sentences(chosen: np.ndarray):
    """doc_id, toxic, bare (sentences without a chosen feature), slots (chosen features of each other one), whole texts read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare, slots = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for i, _, f, own, of, _, _ in features(*kernel.utf8(batch.column(2))):
                row, column = np.nonzero(chosen[f])
                both = np.unique(own[row] * SLOTS + f[row, column])  # distinct in a sentence
                sent, first = np.unique(both // SLOTS, return_index=True)
                for k, x in zip(sent, np.split(both % SLOTS, first[1:]) if len(sent) else (), strict=True):
                    slots[i + of[k]].append(x.astype(np.int32))
                if len(of):
                    np.add.at(bare, i + of, 1)
                    np.subtract.at(bare, i + of[sent], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bare), pa.array(slots, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "bare", "slots"])

    return run


def choose(there: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which features count, and the weights they start from, given how many documents of each class (not toxic, toxic) have them."""
    sizes = [max(1, n) for n in sizes]
    rates = [t / n for t, n in zip(there, sizes, strict=True)]
    pooled = (there[0] + there[1]) / sum(sizes)
    surprise = (rates[1] - rates[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    chosen = (surprise >= SURPRISE) & (rates[1] >= LIFT * rates[0]) & (there[1] >= LEAST_DOCS)
    odds = np.log((there[1] + 0.5) / (sizes[1] + 1)) - np.log((there[0] + 0.5) / (sizes[0] + 1))
    return chosen, np.where(chosen, np.clip(odds, 0, 8), 0.0)


def fit(chosen: np.ndarray, start: np.ndarray, bags: list[list[np.ndarray]], bare: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Full-batch AdaGrad on the weighted log loss of the noisy-or; bags: of each document, the features of its sentences."""
    n = len(bags)
    doc = np.repeat(np.arange(n), [len(b) for b in bags]).astype(np.int64)
    every = [s for b in bags for s in b]
    slot = np.concatenate(every).astype(np.int64) if every else np.zeros(0, np.int64)
    sent = np.repeat(np.arange(len(every)), [len(s) for s in every]).astype(np.int64)
    w, grads = start.copy(), np.full(SLOTS, 1e-7)
    y, n = labels.astype(float), max(1, n)
    bare = bare.astype(float) if len(bags) else np.zeros(1)
    share = weights / weights.sum() if len(bags) else np.zeros(1)
    y = y if len(bags) else np.zeros(1)
    b, lk, gb, gl = -6.0, -4.0, 1e-8, 1e-8
    for _ in range(rounds):
        z = np.clip(np.bincount(sent, w[slot], len(doc)) + b, -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(b, -30, 30)))
        leak = 1 / (1 + np.exp(-lk))
        clean = np.exp(np.bincount(doc, np.log1p(-p), n)[:n] + bare * np.log1p(-p0)) * (1 - leak)
        pull = share * ((1 - y) - y * clean / np.maximum(1 - clean, 1e-9))
        gz = p * pull[doc] if len(doc) else p
        g = np.where(chosen, np.bincount(slot, gz[sent], SLOTS), 0) + 1e-7 * w
        grads += g * g
        w -= 0.2 * g / np.sqrt(grads)
        for value, which in ((gz.sum() + (p0 * pull * bare).sum(), "b"), ((leak * pull).sum(), "l")):
            if which == "b":
                gb += value * value
                b -= 0.3 * value / np.sqrt(gb)
            else:
                gl += value * value
                lk -= 0.3 * value / np.sqrt(gl)
    return Model(w.astype(np.float32), float(b), float(1 / (1 + np.exp(-lk))))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fits on at most PER_CLASS documents of each class, those whose hashed doc_id comes first; allowed: Column of doc_id.

    Whole texts of the sample are read on the executors; the driver has counts by feature and the chosen features of its
    sentences. A doc_id that is labelled more than once counts with its greatest label, one with several texts with each;
    null ids, labels and texts do not count. Each class weighs as much as it has labelled documents. Without labels, a model
    that finds nothing.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids, share = [], {}
    for value in (0, 1):
        own = rows.filter((F.col("toxic") > 0) == bool(value))
        share[value] = own.count()
        ids += [(r.doc_id, value) for r in own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).collect()]
    if not ids:
        return Model(np.zeros(SLOTS, np.float32), -6.0, 0.0)
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id bigint, toxic int"))  # 2 * PER_CLASS at most
    sample = small_batches(docs).filter("text IS NOT NULL").join(wanted, "doc_id").select("doc_id", "toxic", "text")
    there, sizes = np.zeros((2, SLOTS), np.int64), [0, 0]
    found = sample.select("toxic", "text").mapInArrow(_presence, "toxic int, slot int, n bigint").groupBy("toxic", "slot").agg(F.sum("n").alias("n"))
    for batch in found.toArrow().to_batches():  # 2 * SLOTS rows at most
        there[np.asarray(batch.column(0)), np.asarray(batch.column(1))] = np.asarray(batch.column(2))
    for r in sample.groupBy("toxic").count().collect():
        sizes[r.toxic] = r["count"]
    chosen, start = choose(there, sizes)
    got = sample.mapInArrow(_sentences(chosen), "doc_id bigint, toxic int, bare bigint, slots array<array<int>>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["bare"], r["slots"]))
    y = np.array([r["toxic"] for r in got], np.int64)
    weights = np.array([share[v] / sizes[v] for v in y], float)
    return fit(chosen, start, [[np.array(s) for s in r["slots"]] for r in got], np.array([r["bare"] for r in got]), y, weights)


def _scores(model: Model, spans: bool):
    w, bias, leak = model.weights, np.float32(model.bias), model.leak

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = kernel.utf8(batch.column(batch.schema.get_field_index("text")))
            n = batch.num_rows
            score = np.full(n, leak)
            found: list[list] = [[] for _ in range(n if spans else 0)]
            for i, j, f, own, of, start, end in features(raw, at):
                if not len(of):
                    continue
                # weights of a sentence's distinct features: repeats are found within the sentence only where they matter
                hot = np.abs(w[f]).max(axis=1) > 0
                both = np.unique(np.repeat(own[hot], 3) * SLOTS + f[hot].ravel())
                z = np.clip(np.bincount(both // SLOTS, w[both % SLOTS], len(of)) + bias, -30, 30)
                p = 1 / (1 + np.exp(-z))
                score[i:j] = 1 - (1 - leak) * np.exp(np.bincount(of, np.log1p(-p), j - i))
                for k in np.flatnonzero(p >= 0.5) if spans else ():
                    a = at[i + of[k]]
                    found[i + int(of[k])].append({"start": int(start[k] - a), "end": int(end[k] - a), "score": float(p[k])})
            columns = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "text"] + [pa.array(np.clip(score, 0, 1))]
            names = [c for c in batch.schema.names if c != "text"] + ["score"]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score and, if spans, sentences: byte ranges of the text whose own score is 0.5 or more.

    One row for each row of docs; null and wordless texts have the leak alone, and no sentences. Other columns are not
    read; an empty table gives no rows.
    """
    more = ", sentences array<struct<start:bigint,end:bigint,score:double>>" if spans else ""
    return small_batches(docs).select("doc_id", "text").mapInArrow(_scores(model, spans), f"doc_id bigint, score double{more}")


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
            scores = np.asarray(next(_scores(model, False)(iter([own]))).column(0))
            yield batch.filter(pa.array(scores < THRESHOLD))

    return run


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with all of their columns; each row is judged by its own text."""
    return small_batches(docs).mapInArrow(_keep(model), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id takes no part in training; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and the byte ranges of the sentences that offend; labels of held-out documents are not looked at."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(spark, docs, labels, ~held_out(F.col("doc_id")))
    out = score(docs, model)
    where = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), where.alias("sentences"))
