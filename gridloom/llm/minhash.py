"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets and star-shaped edges.

Each text's distinct word shingles are hashed once; a hash's top part names one of BINS bins, and a bin keeps its least
hash. An empty bin borrows from a bin drawn by a fixed random sequence of its own until one is filled (optimal
densification). ROWS bins make a band, and texts with equal bands share a bucket. At the similarity asked for, 0.85, a pair
shares no bucket with a chance of about 1e-8; at 0.8 about 1e-6.

Texts with the same shingle set are one class from the start, so groups of copies cost one row each. In a bucket, every
member is paired with the bucket's centre, the member that meets most others over all of its buckets, not with every other
member. Pairs are confirmed on the full sets, components follow, and a bucket whose members are by then all connected is
done. In the rest, what is not connected yet is compared block against block of about BLOCK members, each pair of blocks a
task of its own: no pair of a bucket stays untested, and only pairs that are similar become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.components import components
from gridloom.llm.scratch import Scratch, small_batches

BANDS = 32
ROWS = 5
BINS = BANDS * ROWS
#: Draws of a bin that an empty bin may make before it takes the next filled bin in order.
DRAWS = 64
#: Members in a block of a bucket, about.
BLOCK = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WAYS = np.random.default_rng(5).integers(0, BINS, (DRAWS, BINS))
_SALT = np.random.default_rng(6).integers(1, 1 << 63, BINS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Document number and its sorted distinct shingle hashes, for documents with words."""
    for i, j, _, _, h, d in kernel.words(raw, at, kernel.SPACED):
        cut = np.searchsorted(d, np.arange(j - i + 1))
        grams = kernel.runs(h, size)
        for x in range(j - i):
            a, b = cut[x], cut[x + 1]
            if b - a >= size:
                yield i + x, np.unique(grams[a : b - size + 1])
            elif b > a:
                yield i + x, kernel.runs(h[a:b], int(b - a))


def sketch(own: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set of hashes."""
    bins = ((own >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)
    out = np.full(BINS, _EMPTY, np.uint64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])  # hashes are sorted, so a bin's first is its least
    out[bins[first].astype(np.int64)] = own[first]
    holes = np.flatnonzero(out == _EMPTY)
    filled = out != _EMPTY
    for draw in _WAYS:
        if not len(holes):
            return out
        got = filled[draw[holes]]
        out[holes[got]] = out[draw[holes[got]]]
        holes = holes[~got]
    there = np.flatnonzero(filled)
    if len(holes):
        out[holes] = out[there[np.searchsorted(there, holes) % len(there)]]
    return out


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a set; equal keys of different bands differ."""
    with np.errstate(over="ignore"):
        return kernel.mix((kernel.mix(sketch(own) ^ _SALT)).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw, at = kernel.utf8(batch.column(1))
            count, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys: list = [None] * n
            for x, own in shingle_sets(raw, at, size):
                count[x] = len(own)
                with np.errstate(over="ignore"):
                    f1[x] = own.sum(dtype=np.uint64)
                    f2[x] = kernel.mix(own ^ _SALT[0]).sum(dtype=np.uint64)
                keys[x] = bands(own).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    raw, at = kernel.utf8(column)
    out: list = [np.zeros(0, np.uint64)] * len(column)
    for x, own in shingle_sets(raw, at, size):
        out[x] = own
    return out


def _confirm(size: int, percent: int):
    """a, b, ta, tb to the pairs a, b whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                ok = []
                for x, y in zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(size: int, percent: int):
    """Members of one block, or of two, of a bucket (id, c, block, i, j, text) to the similar pairs in or across them.

    Shingles are numbered within the group; a set is marked in a table, and one look-up of all others' numbers and a sum
    by set give its intersections with them.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp, block = (table.column(k).combine_chunks().to_numpy() for k in ("id", "c", "block"))
        text = table.column("text").combine_chunks()
        sets = _sets(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, size)
        n = np.array([len(x) for x in sets])
        kept = n > 0  # an id's text may be one without words
        found: list[tuple[np.ndarray, np.ndarray]] = []
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        first = block == table.column("i")[0].as_py()
        seen = np.zeros(len(names), bool)
        own = np.flatnonzero(kept)
        for x in own[first[own]] if across else own:
            mine = number[ends[x] - n[x] : ends[x]]
            others = own[~first[own]] if across else own[own > x]
            others = others[(comp[others] != comp[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
            if not len(others):
                continue
            seen[mine] = True
            hits = np.append(0, np.cumsum(seen[number], dtype=np.int64))
            seen[mine] = False
            both = hits[ends[others]] - hits[ends[others] - n[others]]
            ok = others[100 * both >= percent * (n[x] + n[others] - both)]
            found.append((np.minimum(ids[x], ids[ok]), np.maximum(ids[x], ids[ok])))
        a, b = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are between ASCII white space, with A-Z lower-cased. A text with fewer than size words is one shingle; null and
    wordless texts have the empty set and are linked with nothing. Texts are linked if 100 * intersection >= percent *
    union. component_id is the least doc_id that links reach, and kept says whether that is the row itself. Rows that share
    a doc_id are one document in this: linked, and all kept or all not. A null doc_id with words takes its class's least
    id and is not kept; where no row of its class has an id, component_id is null and it is kept. Other columns are not
    read; an empty table gives no rows.
    """
    tmp = Scratch(spark, "minhash")
    docs = small_batches(docs)
    found = tmp.save(docs.select("doc_id", "text").mapInArrow(_sketches(size), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"), "sketches")
    classes = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2")
    classes = tmp.save(classes.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    keys = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi")
    rows = tmp.save(keys.join(shared.select("key", "members"), "key"), "shared")  # of buckets with several classes
    met = rows.groupBy("id").agg(F.sum("members").alias("met"))
    live = tmp.save(rows.select("key", "id", "n").join(met, "id"), "buckets")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(met.select("id"), "id", "left_semi")
    # a doc_id may hold several texts; any of them can confirm a pair
    texts = tmp.save(texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"]), "texts")

    # round one: every member of a bucket against its centre
    hub = live.groupBy("key").agg(F.max_by("id", "met").alias("id")).join(live, ["key", "id"]).select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    pairs = live.join(hub, "key").filter((F.col("id") != F.col("a")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")))
    pairs = tmp.save(pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    links = tmp.save(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(size, percent), "a bigint, b bigint").distinct(), "links")
    label = components(tmp, links)

    # round two: members that are not connected yet, block against block; buckets with the same members count once
    own = live.join(label, live["id"] == label["id"], "left").select(live["key"], live["id"], F.coalesce(label["component"], live["id"]).alias("c"))
    several = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("lo < hi")
    once = several.groupBy("m", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    left = tmp.save(own.join(once, "key").withColumn("block", F.pmod(F.hash("id"), F.col("blocks"))), "left")
    left = left.select("key", "id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("key", "id", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(texts.select("id", "text"), "id")
    more = left.groupBy("key", "i", "j").applyInArrow(_blocks(size, percent), "a bigint, b bigint")
    more = tmp.save(more.distinct(), "links")
    if not more.isEmpty():
        label = components(tmp, links.unionByName(more))

    cls = classes.join(label, "id", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "id").alias("component"))
    out = found.join(cls, ["n_shingles", "f1", "f2"], "left")
    # rows that share a doc_id fall in one component
    root = F.coalesce(F.col("component"), F.col("doc_id"))
    return tmp.finish(out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, root.isNull()).alias("kept")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 3-word shingles at 0.85."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
