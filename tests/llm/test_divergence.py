"""The audit against its SQL, and tiles against plain integers."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import re

from gridloom.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top):
    """lang, source, text to the audit's rows, with a loop for everything."""
    own, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        own[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {k[0] for k in own}:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        groups = {s: c for (x, s), c in own.items() if x == lang}
        everything = sum(groups.values(), Counter())

        def share(c, kept=kept):
            whole = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // whole for w in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(everything)
        for s in groups:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in groups if o != s]
            terms = [(q[w] - p[s][w], w.encode()) for w in kept if groups[s][w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def rows_of(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def some(n, seed=0, sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Alpha", "beta", "é", "中文", "z") for b in ("", "x", "y", "É", "Q")]
    return [(rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + [None]), " ".join(rng.choices(words, range(1, 26), k=rng.randrange(30))) + "1two2 3") for _ in range(n)]


def test_small_tables_by_blocks(spark, monkeypatch):
    """Several blocks of terms and of groups, and tasks that hand on what they hold in between."""
    rows = some(300)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute(rows, 6, 5)
    assert rows_of(divergence.audit(spark, df, 6, 5)) == want
    monkeypatch.setattr(divergence, "TERMS", 4)
    monkeypatch.setattr(divergence, "GROUPS", 3)
    assert rows_of(divergence.audit(spark, df, 6, 5)) == want


def test_counts_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 20)
    rows = [(lang or "", source or "", text) for lang, source, text in some(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50], strict=True)], ["lang", "source", "text"]) for k in range(0, 200, 50)]
    got, docs = Counter(), Counter()
    parts = list(divergence._count(iter(batches)))
    for r in (x for b in parts for x in b.to_pylist()):
        got[r["lang"], r["source"], r["term"]] += r["n"]
        docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want, seen = Counter(), Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want.update((lang, source, w) for w in terms)
        seen.update((lang, source, w) for w in set(terms))
    assert len(parts) > 2 and +got == want and +docs == seen and {k[:2] for k in got if k[2] is None} == {r[:2] for r in rows}


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        whole = rng.randrange(1, 9 * 10**15)
        count, terms = rng.randrange(whole), rng.randrange(1, 10**6)
        assert int(divergence.shares(np.array([count]), whole, terms)[0]) == 1 + 10**9 * (count + 5) // (whole + 5 * terms)


def test_distances():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 10**9, (7, 300)), rng.integers(0, 10**9, (5, 300))
    assert (divergence.distances(a, b) == [[np.abs(x - y).sum() for y in b] for x in a]).all()


def test_query_is_its_sql(spark):
    where = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
        want = {tuple(r) for r in c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.SQL})").fetchall()}
    assert rows_of(divergence.op12_source_divergence(spark, where)) == want


def test_awkward_tables(spark, awkward):
    rows = [(r.lang, r.source, r.text) for r in awkward.collect()]
    assert rows_of(divergence.audit(spark, awkward, 2, 3)) == brute(rows, 2, 3)
    clash = awkward.selectExpr("*", "'x' AS term", "1 AS n", "2 AS total", "3 AS block")
    assert rows_of(divergence.audit(spark, clash)) == brute(rows, 30, 50)
    assert divergence.audit(spark, awkward.limit(0)).count() == 0
