"""The quality model: its n-grams, optimum and score against slow forms, and accuracy on held-out labels."""

import re

import numpy as np
import pyarrow as pa

from gridloom.llm import kernel, quality


def one(text):
    """raw and at of one text."""
    return kernel.utf8(pa.array([text]))


def slots(text, counts=None):
    return set(np.concatenate([s for _, _, _, s in quality.features(*one(text), counts)]).tolist())


def slow_slots(text):
    """The n-grams of one text, word by word."""
    low = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    hashes = [next(kernel.words(*one(w.decode()), kernel.SPACED))[4][0] for w in words]

    def shape(k):
        w = words[k]
        up, down = len(re.findall(rb"[A-Z]", w)), len(re.findall(rb"[a-z]", w))
        if not up + down:
            case = 0
        elif not up:
            case = 1
        elif up == 1 and re.match(rb"[A-Z]", w) and down:
            case = 2
        else:
            case = 3 if not down else 4
        sign, times = 0, 0
        if re.fullmatch(rb"[!-/:-@\[-`{-~]", w[-1:]):
            sign = w[-1]
            times = min(3, len(w) - len(w.rstrip(w[-1:])))
        return case + 8 * sign + 2048 * times + 8192 * (k > 0 and hashes[k] == hashes[k - 1])

    shapes = kernel.mix(np.array([shape(k) for k in range(len(words))], np.uint64))
    tails = np.array([sum((w.lower()[::-1][k] << 8 * k) for k in range(min(3, len(w)))) for w in words], np.uint64)
    h = np.array(hashes, np.uint64)
    found = [h, kernel.runs(h, 2), tails, shapes, kernel.runs(shapes, 2), kernel.runs(shapes, 3)]
    return {int(x) for k, keys in enumerate(found) for x in kernel.mix(keys ^ quality._SALT[k]) & np.uint64(quality.SLOTS - 1)}


TEXTS = ["The the THE Cat,, sat... on### a+ (mat) A1b2 !! x", "one", "for for for", "é Émile ñ中文... ab\tcd\ne", "WORDS!! ONLY!! here", "a" * 500 + " b " * 300]


def test_ngrams():
    for text in TEXTS:
        assert slots(text) == slow_slots(text)
    counts = np.zeros(quality.SLOTS, bool)
    counts[list(slots(TEXTS[0]))[::2]] = True
    assert slots(TEXTS[0], counts) == {s for s in slots(TEXTS[0]) if counts[s]}
    # documents of one batch do not run into each other
    both = list(quality.features(*kernel.utf8(pa.array(TEXTS))))
    for i, j, doc, slot in both:
        for k in range(i, j):
            assert set(slot[doc == k - i].tolist()) == slow_slots(TEXTS[k])


def test_descent_finds_the_optimum():
    """Primal and dual meet, and no multiplier leaves its box."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 8)) for _ in range(80)]
    values = [rng.normal(size=len(s)) for s in sets]
    y, cost = np.where(rng.random(80) < 0.5, 1.0, -1.0), rng.uniform(0.2, 2.0, 80)
    w, b = quality.descend(sets, values, y, cost, 3000)
    loss = np.maximum(0, 1 - y * np.array([w[s] @ v + b for s, v in zip(sets, values, strict=True)]))
    primal = 0.5 * (w @ w + b * b) + cost @ loss
    for _ in range(100):  # no direction is downhill
        dw, db = np.zeros(quality.SLOTS), rng.normal() * 1e-3
        dw[:40] = rng.normal(size=40) * 1e-3
        other = np.maximum(0, 1 - y * np.array([(w + dw)[s] @ v + b + db for s, v in zip(sets, values, strict=True)]))
        assert 0.5 * ((w + dw) @ (w + dw) + (b + db) ** 2) + cost @ other > primal - 1e-6


def test_logistic_is_the_likeliest():
    rng = np.random.default_rng(2)
    m = rng.normal(size=4000)
    good = rng.random(4000) < 1 / (1 + np.exp(-(2.0 * m - 0.5)))
    slope, offset = quality.logistic(m, good, np.ones(4000))
    assert abs(slope - 2.0) < 0.2 and abs(offset + 0.5) < 0.15


def test_score_is_the_model_s():
    rng = np.random.default_rng(3)
    r, w = rng.normal(size=quality.SLOTS), rng.normal(size=quality.SLOTS)
    r[rng.random(quality.SLOTS) < 0.3] = 0
    m = quality.Model(r.astype(np.float32), w.astype(np.float32), 0.25, 1.5, -0.5)
    got = quality._score(*kernel.utf8(pa.array([*TEXTS, None, "", " \n"])), m)
    for text, score in zip(TEXTS, got, strict=False):
        own = sorted(s for s in slow_slots(text) if m.ratios[s] != 0)
        length = max(1.0, sum(float(m.ratios[s]) ** 2 for s in own) ** 0.5)
        margin = sum(float(m.ratios[s]) * float(m.weights[s]) for s in own) / length + 0.25
        assert abs(score - 1 / (1 + np.exp(-(1.5 * margin - 0.5)))) < 1e-9
    assert np.allclose(got[len(TEXTS) :], 1 / (1 + np.exp(-(1.5 * 0.25 - 0.5))))


def test_held_out(spark):
    got = quality.op13_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    bad = held.quality == 0
    assert bad.sum() > 100 and (held.predicted[bad] == 0).mean() > 0.95 and (held.predicted[~bad] == 1).mean() > 0.99


def test_held_out_labels_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = ~quality.held_out(quality.F.col("doc_id"))
    turned = labels.withColumn("quality", quality.F.when(own, quality.F.col("quality")).otherwise(1 - quality.F.col("quality")))
    a, b = quality.train(spark, docs, labels, own), quality.train(spark, docs, turned, own)
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_awkward(spark, awkward):
    none = quality.train(spark, awkward, spark.createDataFrame([], "doc_id bigint, quality int"), quality.F.lit(True))
    got = quality.score(awkward, none).collect()
    assert len(got) == awkward.count() and all(abs(r.score - 0.5) < 1e-9 for r in got)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (6, None), (8, 1), (7, 1)], "doc_id bigint, quality int")
    m = quality.train(spark, awkward, labels, quality.F.lit(True))
    got = quality.score(awkward.selectExpr("*", "1 AS score", "2 AS good", "3 AS slots"), m).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    one = quality.train(spark, awkward, labels.filter("doc_id IN (7, 8)"), quality.F.lit(True))
    assert {round(r.score, 6) for r in quality.score(awkward, one).collect()} == {0.75}
    assert quality.score(awkward.limit(0), m).count() == 0
