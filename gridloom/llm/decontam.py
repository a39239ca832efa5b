"""Benchmark decontamination by winnowing.

A training document keeps, of every GUARD consecutive k-gram hashes, the least (winnowing). A benchmark item keeps all
of its k-gram hashes, so any span of k + GUARD - 1 = WINDOW words that both have puts at least one common hash in both
sets. An item of fewer than WINDOW words is one window: its whole run is looked up among all of a document's runs of
that length. Before anything is shuffled, documents test their hashes against a bitmap of fixed size with the
benchmark's; what passes is joined on the true hash. Each pair of document and item that the join finds is then extended:
every window of the item is looked up in the whole document and all occurrences are marked word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.scratch import Scratch, small_batches

WINDOW = 13
K = 7
GUARD = WINDOW - K + 1
#: Bits of the bitmap: 1 MiB, however large the benchmark is; with more hashes it lets more through to the join.
BITS = 1 << 23


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = _slots(h)
    return h[((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]


def _item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text to row, size, hash, one row for each distinct fingerprint of an item."""
    for batch in batches:
        rows, sizes, out = [], [], []
        raw, at = kernel.utf8(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j, _, _, h, d in kernel.words(raw, at, kernel.ALNUM):
            for x in range(j - i):
                own = h[d == x] if j - i > 1 else h
                if len(own):
                    found = np.unique(kernel.runs(own, K if len(own) >= WINDOW else len(own)))
                    rows += [ids[i + x]] * len(found)
                    sizes += [min(len(own), WINDOW)] * len(found)
                    out.append(found.view(np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(out))], ["row", "size", "h"])


def _winnowed(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of every GUARD consecutive k-grams within a document, without immediate repeats, and its document."""
    if len(h) < WINDOW:
        return h[:0], d[:0]
    least = kernel.runs(h, K)
    width = 1
    while width < GUARD:
        step = min(width, GUARD - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    own = d[: len(least)]
    keep = own == d[WINDOW - 1 :]
    keep[1:] &= (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    return least[keep], own[keep]


def _doc_hashes(bits_: bytes, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bits_, np.uint8)
        for batch in batches:
            n = batch.num_rows
            raw, at = kernel.utf8(batch.column(1))
            n_words = np.zeros(n, np.int64)
            hits: dict[int, np.ndarray] = {}
            for i, j, _, _, h, d in kernel.words(raw, at, kernel.ALNUM):
                n_words[i:j] = np.bincount(d, minlength=j - i)
                found = [_winnowed(h, d)]
                for k in short:
                    if len(h) >= k:
                        same = d[: len(h) - k + 1] == d[k - 1 :]
                        found.append((kernel.runs(h, k)[same], d[: len(h) - k + 1][same]))
                for x, own in found:
                    a, b = _slots(x)
                    ok = ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
                    for doc in np.unique(own[ok]):
                        more = x[ok][own[ok] == doc]
                        hits[i + int(doc)] = np.concatenate([hits[i + int(doc)], more]) if i + int(doc) in hits else more
            text = batch.column(1)
            keys, values, texts = [None] * n, [None] * n, [None] * n
            for x, found in hits.items():
                whole = raw[at[x] : at[x + 1]].tobytes()
                keys[x], values[x], texts[x] = hashlib.blake2b(whole, digest_size=16).digest(), np.unique(found).view(np.int64), text[x].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["doc_id", "n_words", "key", "hs", "text"])

    return run


def mark(doc: np.ndarray, items: list[tuple[str | None, np.ndarray]]) -> tuple[int, list[str]]:
    """Words of doc inside an occurrence of any item's window, and the ids of items with occurrences, sorted."""
    hit, ids = np.zeros(len(doc) + 1, np.int64), set()
    for size in {min(len(g), WINDOW) for _, g in items} - {0}:
        own = kernel.runs(doc, size)
        wanted = [(name, kernel.runs(g, size)) for name, g in items if min(len(g), WINDOW) == size]
        found = np.isin(own, np.concatenate([w for _, w in wanted]))
        if not found.any():
            continue
        there = np.unique(own[found])
        ids |= {name for name, w in wanted if name is not None and np.isin(w, there).any()}
        at = np.flatnonzero(found)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum()), sorted(ids)


def _one(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return next(kernel.words(raw, np.array([0, len(raw)]), kernel.ALNUM))[4]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, shas = [], [], []
        for text, items in zip(batch.column(1), batch.column(2), strict=True):
            n, ids = mark(_one(text.as_py()), [(x["item_id"], _one(x["text"])) for x in items.as_py()])
            n_hit.append(n)
            n_items.append(len(ids))
            shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string())], ["key", "n_hit", "n_items", "items_sha256"])


def overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    Null and wordless texts have no words and no hits. Items without words have no window. Items that share an item_id
    count once; an item whose id is null marks words but is not counted. Rows that repeat get equal results. An empty
    table on either side gives no hits. Other columns are not read.
    """
    tmp = Scratch(spark, "decontam")
    docs = small_batches(docs)
    items = tmp.save(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").withColumn("row", F.sha2(F.concat_ws("\x00", F.coalesce("item_id", F.lit("")), "text"), 256)).dropDuplicates(["row"]), "items")
    prints = tmp.save(items.select("row", "text").mapInArrow(_item_hashes, "row string, size int, h bigint"), "prints")
    short = sorted(r[0] for r in prints.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    # the bitmap in 64-bit pieces, or-ed on the executors: BITS / 64 rows at most
    slot = F.explode(F.array(F.col("h").bitwiseAND(BITS - 1), F.expr(f"shiftrightunsigned(h, 32) & {BITS - 1}")))
    pieces = prints.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("piece")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bitmap = np.zeros(BITS // 64, np.uint64)
    for piece, bits in pieces.collect():
        bitmap[piece] = np.uint64(bits % (1 << 64))
    scan = _doc_hashes(bitmap.astype("<u8").tobytes(), short)
    found = tmp.save(docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_words bigint, key binary, hs array<bigint>, text string"), "docs")
    texts = found.filter("key IS NOT NULL").dropDuplicates(["key"]).select("key", "hs", "text")
    texts = tmp.save(texts, "texts")
    pairs = texts.select("key", F.explode("hs").alias("h")).join(prints.select("row", "h"), "h").select("key", "row").distinct()
    wanted = pairs.join(items, "row").groupBy("key").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    marked = texts.select("key", "text").join(wanted, "key").mapInArrow(_extend, "key binary, n_hit bigint, n_items bigint, items_sha256 string")
    marked = tmp.save(marked.filter("n_hit > 0"), "marked")
    out = found.select("doc_id", "n_words", "key").join(marked, "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return tmp.finish(out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return overlap(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The same by comparing every window of every item with every position; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    have = [(str(i), split(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, ids = set(), set()
        for name, g in have:
            size = min(len(g), WINDOW)
            for p in range(len(g) - size + 1) if size else ():
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == g[p : p + size]:
                        ids.add(name)
                        hit.update(range(q, q + size))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
