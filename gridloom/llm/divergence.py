"""An audit of how the sources of a language differ in their words, by dense tiles of groups and terms.

Terms are counted on the executors, in array kernels over whole texts. A language's kept terms are dealt into blocks of
about TERMS, and its groups (sources) into blocks of about GROUPS. A tile is the dense int64 matrix of one block of terms
against one or two blocks of groups, with the smoothed shares of counts that are 0 too. In a tile all pairs of groups are
compared at once by broadcasting, which gives a part of each pair's distance, and a group's terms that are over-represented
most go into a heap. Parts are summed by pair, and heaps are merged by group, over all tiles; no task has a whole vocabulary
or all groups of a language.

Shares are integers, 1 + floor(10^9 * (count + SMOOTH) / (total + SMOOTH * terms)), by long division in three steps, so
that nothing overflows below 9 * 10^15 counted terms of a language. Terms are told apart by 64-bit hashes within a batch of
texts, and by their bytes everywhere else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.scratch import Scratch, small_batches

#: A term is kept if this many of a language's documents have it.
LEAST_DOCS = 30
SMOOTH = 5
#: Terms reported of each group.
TOP = 50
#: Terms, and groups, in a block, about: what a tile holds is their product, twice.
TERMS = 1024
GROUPS = 128
#: Distinct (group, term) pairs that a task counts before it hands them on.
HELD = 1 << 19
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[128:] = True
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class _Held:
    """Counts of (group, term) of one task, merged by hash when there are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.texts: list[bytes] = []  # of self.names, in order of first use
        self.names: dict[int, int] = {}

    def add(self, group: np.ndarray, h: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((group, h, n, docs))
        self.size += len(h)

    def merged(self) -> tuple[np.ndarray, ...]:
        group, h, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((h, group))
        group, h, n, docs = group[order], h[order], n[order], docs[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (h[1:] != h[:-1])))
        self.parts = [(group[first], h[first], np.add.reduceat(n, first), np.add.reduceat(docs, first))]
        self.size = len(first)
        return self.parts[0]

    def out(self) -> pa.RecordBatch:
        group, h, n, docs = self.merged()
        keys = list(self.groups)
        at = np.array([self.names[x] for x in h.tolist()], np.int64)
        term = pa.array(self.texts, pa.binary()).cast(pa.string()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]).take(pa.array(group)), pa.array([k[1] for k in keys]).take(pa.array(group)), term, pa.array(n), pa.array(docs)], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, n (occurrences), docs (texts that have it), and each group once with a null term."""
    held, seen = _Held(), set()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        raw, at = kernel.utf8(batch.column(2))
        number = np.array([held.groups.setdefault(k, len(held.groups)) for k in zip(langs, sources, strict=True)], np.int64)
        for i, j, s, e, h, d in kernel.words(raw, at, _LETTERS):
            if not len(h):
                continue
            order = np.lexsort((h, d))  # a document's own counts, then what its group has of them
            hs, ds = h[order], d[order]
            first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])))
            n = np.diff(np.append(first, len(hs)))
            some, back = np.unique(hs[first], return_index=True)
            for x, k in zip(some.tolist(), order[first[back]].tolist(), strict=True):
                if x not in held.names:
                    held.names[x] = len(held.texts)
                    held.texts.append(kernel.LOWER[raw[s[k] : e[k]]].tobytes())
            held.add(number[i + ds[first]], hs[first], n, np.ones(len(first), np.int64))
            if held.size >= 2 * HELD:
                held.merged()
                if held.size >= HELD:
                    seen |= set(held.groups)
                    yield held.out()
                    held = _Held()
                    number = np.array([held.groups.setdefault(k, len(held.groups)) for k in zip(langs, sources, strict=True)], np.int64)
    if held.parts:
        yield held.out()
    keys = list(seen | set(held.groups))
    none = np.zeros(len(keys), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.nulls(len(keys), pa.string()), pa.array(none), pa.array(none)], schema=_COUNTS)


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + SMOOTH) / (total + SMOOTH * terms)) of int64 arrays, exactly."""
    whole = np.asarray(total, np.int64) + SMOOTH * terms
    rest = np.asarray(count, np.int64) + SMOOTH
    out = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all pairs of rows of two tiles, a few rows at a time."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(axis=2)
    return out


_TILE = "lang string, source string, part string, item string, value bigint"


def _tile(least: int):
    def run(table: pa.Table) -> pa.Table:
        """One tile: rows of groups (term is null) and of counts. Parts of pairs' distances both ways, and heaps of the diagonal's groups."""
        lang, i, j, terms = (table.column(c)[0].as_py() for c in ("lang", "i", "j", "terms"))
        source, term, n = table.column("source").to_pylist(), table.column("term").to_pylist(), table.column("n").to_pylist()
        block, total, whole = table.column("block").to_pylist(), table.column("total").to_pylist(), table.column("whole").to_pylist()
        groups = {(s, b): (k, t) for k, (s, b, t) in enumerate(sorted({(s, b, t) for s, b, t, w in zip(source, block, total, term, strict=True) if w is None}))}
        # every term of the block is a row of it without a source, which has the language's counts
        names = sorted({w for s, w in zip(source, term, strict=True) if s is None})
        place = {w: k for k, w in enumerate(names)}
        counts, every = np.zeros((len(groups), len(names)), np.int64), np.zeros(len(names), np.int64)
        for s, b, w, x in zip(source, block, term, n, strict=True):
            if s is None:
                every[place[w]] = x
            elif w is not None:
                counts[groups[s, b][0], place[w]] = x
        totals = np.array([t for _, t in groups.values()], np.int64).reshape(-1, 1)
        p = shares(counts, totals, terms) if len(names) else np.zeros((len(groups), 0), np.int64)
        keys = list(groups)
        first = np.array([b == i for _, b in keys], bool)
        rows, cols = np.flatnonzero(first), np.arange(len(keys)) if i == j else np.flatnonzero(~first)
        found: list[tuple[str, str, str, int]] = []
        apart = distances(p[rows], p[cols])
        for x, r in enumerate(rows):
            for y, c in enumerate(cols):
                if r != c:
                    found.append((keys[r][0], "pair", keys[c][0], int(apart[x, y])))
                    if i != j:
                        found.append((keys[c][0], "pair", keys[r][0], int(apart[x, y])))
        if i == j and names:
            q = shares(every, whole[0], terms)
            for r in rows:
                over = np.flatnonzero((counts[r] > 0) & (p[r] > q))
                f = (p[r] - q)[over]
                if len(over) > least:  # the heap's least value, and all that tie with it
                    cut = -np.partition(-f, least - 1)[least - 1]
                    over, f = over[f >= cut], f[f >= cut]
                best = heapq.nsmallest(least, ((-int(v), names[k].encode()) for v, k in zip(f, over, strict=True)))
                found += [(keys[r][0], "term", w.decode(), -v) for v, w in best]
        columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array(columns[0], pa.string()), "part": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})

    return run


def _dealt(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language, and its own terms.

    A null text, lang or source is empty. Terms are runs of letters and of all beyond ASCII, with A-Z lower-cased; a language
    keeps those in least_docs of its documents, rows that repeat being documents of their own. Part pair: all other
    sources of the language, by the sum of absolute differences of their shares of all kept terms. Part term: the top
    terms that the group has a larger share of than the language. Ranks are by value, greatest first, then by item. A language
    of one source has no pairs, one without kept terms has distances 0. Other columns are not read; an empty table
    gives no rows.
    """
    tmp = Scratch(spark, "divergence")
    given = small_batches(docs).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = given.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counted = tmp.save(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = tmp.save(kept, "terms")
    counts = tmp.save(counted.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"], "left_semi"), "kept")

    # a row for each group, a row for each language
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = tmp.save(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("whole"))
    sizes = sizes.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    sizes = sizes.select("lang", "terms", "whole", F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int").alias("tb"), F.ceil(F.col("groups") / GROUPS).cast("int").alias("gb"))
    sizes = tmp.save(sizes, "sizes")

    # tiles: pairs of blocks of groups by blocks of terms; what a row is of goes to each of them
    def to_tiles(rows: DataFrame) -> DataFrame:
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)))
        return other.select("lang", "tb", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", "block", "term", "n", "total", "terms", "whole")

    zero, no = F.lit(0).cast("long"), F.lit(None).cast("string")
    there = groups.join(sizes, "lang").withColumn("block", _dealt(F.col("source"), F.col("gb"))).withColumn("n", zero).withColumn("term", no)
    there = to_tiles(there.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tb") - 1))))
    own = counts.join(sizes, "lang").withColumn("tb", _dealt(F.col("term"), F.col("tb"))).withColumn("block", _dealt(F.col("source"), F.col("gb"))).withColumn("total", zero)
    names = kept.join(sizes, "lang").withColumn("tb", _dealt(F.col("term"), F.col("tb"))).withColumn("source", no).withColumn("total", zero)
    names = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("gb") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("gb") - 1))).withColumn("block", F.col("i"))
    rows = there.unionByName(to_tiles(own)).unionByName(names.select(*there.columns))
    parts = tmp.save(rows.groupBy("lang", "tb", "i", "j").applyInArrow(_tile(top), _TILE), "parts")

    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(parts.filter("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = both.filter("part = 'pair'").withColumn("rank", F.row_number().over(order)).unionByName(both.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return tmp.finish(ranked.withColumn("rank", F.col("rank").cast("int")), "audit")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), o AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0)::HUGEINT + {SMOOTH} * v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), w AS (
  SELECT lang, sum(total) AS whole FROM t GROUP BY lang
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.n) + {SMOOTH})) // (any_value(w.whole)::HUGEINT + {SMOOTH} * any_value(v.v)) AS q
  FROM k JOIN c ON c.lang = k.lang AND c.term = k.term JOIN w ON w.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY k.lang, k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), both_parts AS (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value, row_number() OVER (PARTITION BY p.lang, p.source ORDER BY p - q DESC, p.term) AS rank
    FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q) WHERE rank <= {TOP}
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM both_parts
"""
