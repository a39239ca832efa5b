"""Text quality by a support vector machine over naive Bayes features.

A document is the set of its n-grams: words, pairs of words, ends of words, and one to three consecutive word shapes (case,
what a word ends in, and whether it repeats the one before). The indicator of an n-gram is scaled by its class log-count
ratio, the log of how much likelier it is in good than in bad documents, each document is scaled to length one, and a
linear model with hinge loss is fitted to that by dual coordinate descent. Margins become probabilities by a logistic
that is fitted to margins of documents that the model in question did not see.
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
#: n-grams that start (or, of shapes and pairs, end) at a word.
KINDS = 6
#: Bound of the training sample: labelled documents of each class. Whole texts of them are read, on the executors.
PER_CLASS = 3000
#: An n-gram counts if this many documents of the sample have it ...
LEAST_DOCS = 5
#: ... and its rates in the classes differ by this many standard errors.
SURPRISE = 3.0
#: Weight of an error against the length of the model, passes over the sample, and folds for margins of unseen documents.
COST = 1.0
PASSES = 30
FOLDS = 4
THRESHOLD = 0.7
_SALT = np.random.default_rng(13).integers(1, 1 << 63, KINDS, dtype=np.uint64)
_UPPER, _LOWER, _SIGN = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = 1, 1
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True


@dataclass(frozen=True)
class Model:
    """Log-count ratios and weights by slot (0 where an n-gram does not count), the bias, and the logistic's slope and offset."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _shapes(raw: np.ndarray, lo: int, hi: int, s: np.ndarray, e: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A number for each word: case, last sign and how many of it, and whether the word is the one before again."""
    own = raw[lo:hi]
    ups, lows = np.append(np.int32(0), np.cumsum(_UPPER[own], dtype=np.int32)), np.append(np.int32(0), np.cumsum(_LOWER[own], dtype=np.int32))
    up, low = ups[e - lo] - ups[s - lo], lows[e - lo] - lows[s - lo]
    case = np.where(up + low == 0, 0, np.where(up == 0, 1, np.where((up == 1) & (_UPPER[raw[s]] == 1) & (low > 0), 2, np.where(low == 0, 3, 4))))
    last = raw[e - 1]
    sign = np.where(_SIGN[last], last, 0).astype(np.int64)
    times = np.zeros(len(h), np.int64)
    for k in (1, 2, 3):
        times += (sign > 0) & (e - s >= k) & (raw[np.maximum(e - k, s)] == last) & (times == k - 1)
    again = np.append(False, (h[1:] == h[:-1]) & (d[1:] == d[:-1]))
    return case + 8 * sign + (times << 11) + (again.astype(np.int64) << 13)


def features(raw: np.ndarray, at: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each group of documents: i, j, and (document less i, slot) of their distinct n-grams (that count), in order of both."""
    for i, j, s, e, h, d in kernel.words(raw, at, kernel.SPACED):
        if not len(h):
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        shape = kernel.mix(_shapes(raw, int(at[i]), int(at[j]), s, e, h, d).astype(np.uint64))
        tail = np.zeros(len(h), np.uint64)
        for k in range(3):
            tail |= np.where(e - s > k, kernel.LOWER[raw[np.maximum(e - 1 - k, s)]], 0).astype(np.uint64) << np.uint64(8 * k)
        found = []
        for k, (keys, size) in enumerate(((h, 1), (kernel.runs(h, 2), 2), (tail, 1), (shape, 1), (kernel.runs(shape, 2), 2), (kernel.runs(shape, 3), 3))):
            inside = d[: len(keys)] == d[size - 1 :][: len(keys)]  # of one document
            slot = (kernel.mix(keys[inside] ^ _SALT[k]) & np.uint64(SLOTS - 1)).astype(np.int64)
            both = d[: len(keys)][inside] * SLOTS + slot
            found.append(np.unique(both if counts is None else both[counts[slot]]))
        both = np.unique(np.concatenate(found))
        yield i, j, both // SLOTS, both % SLOTS


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """good, slot, n: of batches of good, text, documents of a class that have an n-gram, for a task."""
    there = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        good = np.asarray(batch.column(0))
        for i, j, doc, slot in features(*kernel.utf8(batch.column(1))):
            np.add.at(there, (good[i:j][doc], slot), 1)
    value, slot = np.nonzero(there)
    yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(there[value, slot])], ["good", "slot", "n"])


def _sets(counts: np.ndarray):
    """doc_id, good, text to doc_id, good, slots: the n-grams of the whole text that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list = [np.zeros(0, np.int32)] * batch.num_rows
            for i, j, doc, slot in features(*kernel.utf8(batch.column(2)), counts):
                slot = slot.astype(np.int32)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                own[i:j] = [slot[cut[x] : cut[x + 1]] for x in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "good", "slots"])

    return run


def ratios(there: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The log-count ratio of each n-gram that counts, and 0, given how many documents of each class (bad, good) have it."""
    sizes = [max(1, n) for n in sizes]
    rates = [t / n for t, n in zip(there, sizes, strict=True)]
    pooled = (there[0] + there[1]) / sum(sizes)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    counts = (there[0] + there[1] >= LEAST_DOCS) & (np.abs(rates[1] - rates[0]) >= SURPRISE * error)
    r = np.log((there[1] + 1) / (there[1] + 1).sum()) - np.log((there[0] + 1) / (there[0] + 1).sum())
    return np.where(counts, r, 0.0)


def scaled(sets: list[np.ndarray], r: np.ndarray) -> list[np.ndarray]:
    """Values of each document's n-grams: their ratios, scaled to length one (or shorter, where all ratios are small)."""
    return [(v := r[s]) / max(1.0, float(np.sqrt(v @ v))) for s in sets]


def descend(sets: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and bias. y is -1 or 1, cost bounds each document's multiplier."""
    w, b, a = np.zeros(SLOTS), 0.0, np.zeros(len(sets))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for k in rng.permutation(len(sets)):
            s, v = sets[k], values[k]
            g = y[k] * (float(w[s] @ v) + b) - 1.0
            new = min(max(a[k] - g / norm[k], 0.0), cost[k])
            if step := (new - a[k]) * y[k]:
                w[s] += step * v
                b += step
                moved = max(moved, abs(step))
                a[k] = new
        if moved < 1e-4:
            break
    return w, b


def logistic(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic, by Newton's steps, with targets drawn in as by one more document of each class."""
    up, down = (weight * good).sum(), (weight * ~good).sum()
    t = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    p = np.array([1.0, np.log((up + 1) / (down + 1))])

    def loss(p: np.ndarray) -> float:
        z = x @ p
        return float((weight * (np.logaddexp(0, z) - t * z)).sum() + 1e-6 * (p @ p))

    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        gradient = x.T @ (weight * (q - t)) + 2e-6 * p
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        size, now = 1.0, loss(p)
        while size > 1e-6 and loss(p - size * step) > now:
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(p[0]), 0.0), float(p[1])


def fit(sets: list[np.ndarray], good: np.ndarray, weight: np.ndarray, r: np.ndarray, folds: int = FOLDS) -> Model:
    """The model of a sample: sets of n-grams that count, labels, weights of documents, ratios."""
    good = good.astype(bool)
    if good.all() or not good.any():  # one class, or none: its share is all there is to know
        offset = float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
        return Model(r.astype(np.float32), np.zeros(SLOTS, np.float32), 0.0, 0.0, offset)
    y, cost, values = np.where(good, 1.0, -1.0), COST * weight / weight.mean(), scaled(sets, r)
    margin, fold = np.zeros(len(sets)), np.arange(len(sets)) % folds
    for k in range(folds):
        seen, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, b = descend([sets[x] for x in seen], [values[x] for x in seen], y[seen], cost[seen])
        margin[held] = [float(w[sets[x]] @ values[x]) + b for x in held]
    slope, offset = logistic(margin, good, weight)
    w, b = descend(sets, values, y, cost)
    return Model(r.astype(np.float32), w.astype(np.float32), float(b), slope, offset)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fits on at most PER_CLASS documents of each class, those whose hashed doc_id comes first; allowed: Column of doc_id.

    Whole texts of the sample are read on the executors; the driver has counts by slot and the n-grams of its documents
    that count. A doc_id that is labelled more than once counts with its least label, one with several texts with each;
    null ids, labels and texts do not count. Each class weighs as much as it has labelled documents. Without labels, or with
    those of one class, a score for all.
    """
    rows = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(allowed).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids, share = [], {}
    for value in (0, 1):
        own = rows.filter((F.col("quality") > 0) == bool(value))
        share[value] = own.count()
        ids += [(r.doc_id, value) for r in own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).collect()]
    there, sizes, got = np.zeros((2, SLOTS), np.int64), [0, 0], []
    if ids:
        wanted = F.broadcast(spark.createDataFrame(ids, "doc_id bigint, good int"))  # 2 * PER_CLASS at most
        sample = small_batches(docs).filter("text IS NOT NULL").join(wanted, "doc_id").select("doc_id", "good", "text")
        found = sample.select("good", "text").mapInArrow(_presence, "good int, slot int, n bigint").groupBy("good", "slot").agg(F.sum("n").alias("n"))
        for batch in found.toArrow().to_batches():  # 2 * SLOTS rows at most
            there[np.asarray(batch.column(0)), np.asarray(batch.column(1))] = np.asarray(batch.column(2))
        for r in sample.groupBy("good").count().collect():
            sizes[r.good] = r["count"]
    r = ratios(there, sizes)
    if ids:
        table = sample.mapInArrow(_sets(r != 0), "doc_id bigint, good int, slots array<int>").toArrow()
        for batch in table.to_batches():
            slots, cut = np.asarray(batch.column(2).values), np.asarray(batch.column(2).offsets)
            got += [(d, g, slots[cut[k] : cut[k + 1]]) for k, (d, g) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
        got.sort(key=lambda x: (x[0], x[1], len(x[2]), x[2].tobytes()))
    good = np.array([g for _, g, _ in got], np.int64)
    return fit([s.astype(np.int64) for _, _, s in got], good, np.array([share[g] / sizes[g] for g in good], float), r)


def _score(raw: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    n = len(at) - 1
    margin = np.full(n, model.bias)
    r, w = model.ratios.astype(float), model.weights.astype(float)
    for i, j, doc, slot in features(raw, at, r != 0):
        v = r[slot]
        length = np.maximum(1.0, np.sqrt(np.bincount(doc, v * v, j - i)))
        margin[i:j] = np.bincount(doc, v * w[slot], j - i) / length + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(*kernel.utf8(batch.column(1)), model))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of good quality, a row for each row of docs.

    Null and wordless texts have no n-grams and score what the bias gives. Other columns are not read; an empty table gives
    no rows.
    """
    return small_batches(docs).select("doc_id", "text").mapInArrow(_scores(model), "doc_id bigint, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id takes no part in training; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out documents are not looked at."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(spark, docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
