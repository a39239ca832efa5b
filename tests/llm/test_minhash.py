import re

import numpy as np

from gridloom.llm import minhash


def brute(docs, size, percent):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sets = []
    for _, t in docs:
        w = split(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)], d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def test_against_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rng = np.random.default_rng(1)
    for k in range(60):  # chains of near copies around the threshold
        base = docs[k % 12][1].split()[:120] if k < 12 else docs[-1][1].split()
        for _ in range(int(rng.integers(1, 6))):
            base[int(rng.integers(0, len(base)))] = f"w{k}"
        docs.append((10_000 - k, " ".join(base)))
    got = minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 3, 85)


def test_awkward(spark, awkward):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, awkward).collect()}
    assert {(1, 14, 1, True), (5, 14, 1, False), (None, 14, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (6, 1, 6, True)} <= got
    assert minhash.near_duplicates(spark, awkward.limit(0)).count() == 0


def test_bucket_with_unlike_members_is_exhausted(spark, monkeypatch):
    """All texts in one bucket: pairs that do not hang on the centre are found block by block."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "_sketches", lambda size, real=minhash._sketches: _one_bucket(real(size)))
    base = [[f"a{g}x{i}" for i in range(60)] for g in range(5)]
    docs = [(g * 10 + v, " ".join(base[g][:57] + [f"v{v}"] + base[g][58:])) for g in range(5) for v in range(4)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 3, 85)


def _one_bucket(run):
    def wrapped(batches):
        import pyarrow as pa

        for b in run(batches):
            same = pa.array([None if k is None else [7] for k in b.column(4).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], same], b.schema.names)

    return wrapped
