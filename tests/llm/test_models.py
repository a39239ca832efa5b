import re

import numpy as np

from gridloom.llm import langid, toxicity


def test_gradient_is_right():
    """Backpropagation through time against finite differences, in double precision."""
    rng = np.random.default_rng(0)
    m = langid._blank(["a", "b", "c"], np.float64, 1)
    x = rng.integers(0, 256, (9, 5)).astype(np.int16)
    x[6:, 1] = langid._PAD
    y = np.array([0, 1, 2, 1, 0])
    loss, grads = langid.gradient(m, x, y)
    params = [*m.embedded, *m.recurrent, *m.out, m.bias]
    for p, g in zip(params, grads, strict=True):
        where = [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(rng.integers(0, s) for s in g.shape)]
        for at in where:
            if g[at] == 0:
                continue
            old = p[at]
            p[at] = old + 1e-5
            up, _ = langid.gradient(m, x, y)
            p[at] = old - 1e-5
            down, _ = langid.gradient(m, x, y)
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6 + 1e-4 * abs(g[at])


def test_positions_and_padding():
    m = langid._blank(["a", "b"], np.float32, 1)
    x = np.full((langid.STRETCH, 2), langid._PAD, np.int16)
    x[:5, 0] = x[:5, 1] = [97, 98, 99, 100, 101]
    p = langid.positions(m, x)
    assert np.allclose(p[:5], langid.positions(m, x[:5]), atol=1e-6) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_language_held_out(spark):
    got = langid.op4_language(spark, "/root/testdata/sf0.01").toPandas()
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(want, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(want) and len(held) > 150
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_awkward(spark, awkward):
    m = langid.fit([("en", b"the cat and the dog " * 5), ("fr", b"le chat et le chien " * 5)], rounds=5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(awkward, m).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[8][0] in ("en", "fr") and langid.identify(awkward, m).count() == awkward.count()
    assert langid.train(spark, awkward.limit(0), langid.F.lit(True)) is None and langid.identify(awkward, None).filter("lang_pred = 'und'").count() == awkward.count()
    assert langid.identify(awkward.limit(0), m).count() == 0


def test_every_language_and_the_whole_text_is_learnt(spark):
    """More languages than any bound there was, and stretches from all over a long text."""
    rows = [(k, f"l{k % 70:02d}", f"tongue{k % 70} " * 40) for k in range(140)] + [(999, "long", "a" * 300_000 + "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    pieces = docs.mapInArrow(langid._pieces, "lang string, place bigint, size bigint, bytes binary").collect()
    assert {r.lang for r in pieces} == {r[1] for r in rows}
    own = [bytes(r["bytes"]) for r in pieces if r.lang == "long"]
    assert len(own) == langid.STRETCHES and {x[:1] for x in own} == {b"a", b"z"}


def test_long_toxic_documents_are_learnt_from(spark):
    clean = [(d, f"plain words only here. Number{d} it is. " * 3) for d in range(40)]
    long = [(100 + d, "plain words only here. " * 6000 + "It is awfulword here.") for d in range(8)]
    docs = spark.createDataFrame(clean + long, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in clean + long], "doc_id bigint, toxic int")
    m = toxicity.train(spark, docs, labels, toxicity.F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    assert all(got[d].score >= toxicity.THRESHOLD and len(got[d].sentences) == 1 for d, _ in long)
    assert all(got[d].score < toxicity.THRESHOLD for d, _ in clean)


def test_toxicity_learns_words_and_finds_sentences(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(200)]
    bad = ["vilething", "foulname", "nastyone"]
    docs, labels, place = [], [], {}
    for d in range(600):
        sents = [[str(rng.choice(plain)) for _ in range(8)] for _ in range(int(rng.integers(1, 9)))]
        toxic = d % 3 == 0
        if toxic:
            place[d] = int(rng.integers(0, len(sents)))
            sents[place[d]][3] = bad[d % 9 // 3]
        docs.append((d, ". ".join(" ".join(s) for s in sents) + "."))
        labels.append((d, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    own = spark.createDataFrame(docs, "doc_id bigint, text string")
    m = toxicity.train(spark, own, spark.createDataFrame(labels, "doc_id bigint, toxic int"), ~toxicity.held_out(toxicity.F.col("doc_id")))
    out = {r.doc_id: r for r in toxicity.score(own, m).collect()}
    right = [(out[d].score >= toxicity.THRESHOLD) == (d % 3 == 0) for d, _ in docs]
    assert np.mean(right) > 0.98
    hits = 0
    for d, k in place.items():
        s = re.split(r"(?<=\.) ", docs[d][1])
        lo = sum(len(x) + 1 for x in s[:k])
        hits += [(x.start, x.end) for x in out[d].sentences] == [(lo, lo + len(s[k]) - 1)]
    assert hits > 0.95 * len(place)


def test_toxicity_held_out(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(lab, on="doc_id")
    order = held.score.rank()
    pos = held.toxic == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85 and got.score.between(0, 1).all()
    assert ((held.predicted == 1) & ~pos).sum() <= 0.01 * (~pos).sum()


def test_toxicity_awkward(spark, awkward):
    none = toxicity.train(spark, awkward, spark.createDataFrame([], "doc_id bigint, toxic int"), toxicity.F.lit(True))
    got = toxicity.score(awkward, none).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(awkward.limit(0), none).count() == 0
