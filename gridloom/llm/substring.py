"""Substring dedup by hashing lines, runs of short lines, and every run of LONG words that is shared.

A unit is a line of at least LEAST words. Lines under LEAST words are joined with the lines behind them, and with those
before them, to runs of as many lines as it takes. A document of LONG words or more is a unit as a whole, so that of equal
documents only the first needs windows. A window is LONG consecutive words, wherever they start and whatever lines they
cross. To hash only the windows that can be shared, each document first emits seeds: of each LONG - SEED + 1 consecutive
runs of SEED words that with the least hash, so that two equal windows have an equal seed. Windows around the seeds that two
documents have are then grouped like units, so that a shared passage of LONG words or more goes from its first to its last
word. If sentences are asked for, units are also what starts at a sentence within a line and runs over as many sentences as
it takes to reach the least size (for shorter sentences also what ends there); these find shorter passages, and much that
documents share by chance.

Units and windows are normalised to their words, lower-cased, without punctuation or spacing; their 128-bit digests are grouped
globally. The document with the least doc_id keeps a unit, in its first place, and it is removed everywhere else. What is
removed is reported as ranges of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import kernel
from gridloom.llm.scratch import Scratch, small_batches

#: Words of a unit at least; what is shorter repeats in documents that have nothing else in common.
LEAST = 20
LONG, SEED = 50, 25
_SENTENCE, _LINE = np.zeros(256, bool), np.zeros(256, bool)
_SENTENCE[[10, 13, 33, 46, 63]] = _LINE[[10]] = True


def _digest(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word range [a, b)."""
    up, down = kernel._pow(len(h) + 1)
    out = []
    with np.errstate(over="ignore"):
        for own in (h, kernel.mix(h ^ np.uint64(0x5851F42D4C957F2D))):
            total = np.append(np.uint64(0), np.cumsum(own * up[: len(h)]))
            out.append(kernel.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
    return out[0], out[1]


def units(raw: np.ndarray, lo: int, hi: int, s: np.ndarray, d: np.ndarray, least: int, sentences: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the units of a group of documents, by start and then end."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = raw[lo:hi]

    def firsts(table: np.ndarray) -> np.ndarray:
        n = np.cumsum(table[part], dtype=np.int32)[s - lo]
        return np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (d[1:] != d[:-1])))

    line = firsts(_LINE)
    line_end = np.append(line[1:], len(s))
    whole = line_end - line >= least
    doc = d[line]
    onto = np.searchsorted(line_end, line + least)  # runs of lines from or up to a short one
    run = ~whole & (onto < len(line))
    run[run] = doc[onto[run]] == doc[run]
    back = np.searchsorted(line, line_end - least, "right") - 1
    tail = ~whole & (back >= 0) & (doc[back] == doc)
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    last = np.append(first[1:], len(s))
    long = last - first >= LONG
    starts = [line[whole], line[run], line[back[tail]], first[long]]
    ends = [line_end[whole], line_end[onto[run]], line_end[tail], last[long]]
    if sentences:
        a = firsts(_SENTENCE)
        b = np.append(a[1:], len(s))
        of = np.searchsorted(line, a, "right") - 1
        ahead = np.searchsorted(b, a + least)
        ok = ahead < len(b)
        ok[ok] = of[ahead[ok]] == of[ok]
        behind = np.searchsorted(a, b - least, "right") - 1
        short = (b - a < least) & (behind >= 0) & (of[behind] == of)
        starts, ends = [*starts, a[ok], a[behind[short]]], [*ends, b[ahead[ok]], b[short]]
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.unique(starts * (len(s) + 1) + ends)
    return order // (len(s) + 1), order % (len(s) + 1)


def _windows(h: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k words that lie within a document."""
    return np.flatnonzero(d[k - 1 :] == d[: len(d) - k + 1]) if len(h) >= k else np.zeros(0, np.int64)


def _slide(x: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """pick over each k consecutive values, by doubling."""
    m, n = 1, len(x) - k + 1
    while 2 * m <= k:
        x, m = pick(x[: len(x) - m], x[m:]), 2 * m
    return pick(x[:n], x[k - m : k - m + n])


def seeds(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of runs of SEED words, one at least in every run of LONG words of a document."""
    w = LONG - SEED + 1
    whole = _windows(h, d, LONG)
    if not len(whole):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.arange(len(h) - SEED + 1)
    x = _digest(h, a, a + SEED)[0]
    least = np.zeros(len(x) + w - 1, np.uint64)  # where no window starts, 0, which no run is picked by
    least[w - 1 + whole] = _slide(x, w, np.minimum)[whole]
    at = np.flatnonzero((_slide(least, w, np.maximum) == x) & (x > 0))
    return x[at], at


def _distinct(d1: np.ndarray, d2: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((d2, d1, own))
    d1, d2, own = d1[order], d2[order], own[order]
    new = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (own[1:] != own[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(d1[new].view(np.int64)), pa.array(d2[new].view(np.int64)), pa.array(own[new])], ["d1", "d2", "doc"])


def _emit_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = kernel.utf8(batch.column(1))
        ids = np.asarray(batch.column(0))
        for i, _, _, _, h, d in kernel.words(raw, at, kernel.ALNUM):
            x, a = seeds(h, d)
            if len(x):
                own, start = np.unique(d, return_index=True)
                text = _digest(h, start, np.append(start[1:], len(h)))[0]
                yield _distinct(x, text[np.searchsorted(own, d[a])], ids[i + d[a]]).rename_columns(["seed", "same", "doc"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that hold one of a document's seeds."""
    for batch in batches:
        for doc, text, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            _, _, _, _, h, d = next(kernel.words(raw, np.array([0, len(raw)]), kernel.ALNUM))
            if len(h) < LONG:
                continue
            a = np.arange(len(h) - SEED + 1)
            hit = np.flatnonzero(np.isin(_digest(h, a, a + SEED)[0].view(np.int64), np.asarray(own.values)))
            n = len(h) - LONG + 1
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.minimum(np.maximum(hit - (LONG - SEED), 0), n), 1)
            np.add.at(near, np.minimum(hit + 1, n), -1)
            a = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            if len(a):
                yield _distinct(*_digest(h, a, a + LONG), np.full(len(a), doc.as_py(), np.int64))


def _emit(least: int, sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = kernel.utf8(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i, j, s, _, h, d in kernel.words(raw, at, kernel.ALNUM):
                a, b = units(raw, int(at[i]), int(at[j]), s, d, least, sentences)
                if len(a):
                    d1, d2 = _digest(h, a, b)
                    yield _distinct(d1, d2, ids[i + d[a]])

    return run


def _long(h: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of a document's windows that are in windows (first hashes), or that repeat an earlier one of its own.

    A repeat that overlaps its first place starts behind it, so that the first place stays whole.
    """
    if len(h) < LONG:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.arange(len(h) - LONG + 1)
    key = _digest(h, a, a + LONG)[0].view(np.int64)
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    first = first[of]
    other = np.isin(key, windows)
    at = np.flatnonzero(other | (first < a))
    return np.where(other, a, np.maximum(a, first + LONG))[at], at + LONG


def cut(text: str, others: set[tuple[int, int]], windows: np.ndarray | None = None, least: int = LEAST, sentences: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """The text without the units in others, the windows in windows and its own repeats, and what was removed, in code points."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    _, _, s, e, h, d = next(kernel.words(raw, np.array([0, len(raw)]), kernel.ALNUM))
    a, b = units(raw, 0, len(raw), s, d, least, sentences)
    x, y = _long(h, np.zeros(0, np.int64) if windows is None else windows)
    if not len(a) and not len(x):
        return text, []
    d1, d2 = _digest(h, a, b)
    seen: dict[tuple[int, int], int] = {}
    gone = np.zeros(len(s) + 1, np.int64)
    np.add.at(gone, x, 1)
    np.add.at(gone, y, -1)
    any_gone = len(x) > 0
    for x, y, key in zip(a, b, zip(d1.view(np.int64).tolist(), d2.view(np.int64).tolist(), strict=True), strict=True):
        if key in others or key in seen:
            gone[x if key in others else max(x, seen[key])] += 1  # a repeat that overlaps its first place starts behind it
            gone[y] -= 1
            any_gone = True
        seen.setdefault(key, y)
    if not any_gone:
        return text, []
    gone = np.cumsum(gone[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    ranges = []
    for x, y in zip(edge[0::2], edge[1::2], strict=True):
        start, end = int(s[x]), int(s[y]) if y < len(s) else len(raw)
        after = data.rfind(b"\n", int(e[y - 1]), end)
        if after >= 0:  # its line ends behind it: the line break goes only if the line's start goes, too
            end = after + 1 if start == 0 or data[start - 1 : start] == b"\n" else after
        ranges.append((start, end))
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    kept, last = [], 0
    for start, end in ranges:
        kept.append(data[last:start])
        last = end
    kept.append(data[last:])
    return b"".join(kept).decode(), [(int(points[x]), int(points[y])) for x, y in ranges]


def _cut(least: int, sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, others, windows in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                t, o = text.as_py(), others.as_py()
                own = np.asarray(windows.values) if windows.is_valid else None
                new, ranges = (t, []) if t is None else cut(t, {(x["d1"], x["d2"]) for x in o or ()}, own, least, sentences)
                texts.append(new)
                removed.append([{"start": x, "end": y} for x, y in ranges])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, kind)], ["doc_id", "text", "removed"])

    return run


def dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST, sentences: bool = False) -> DataFrame:
    """doc_id, text without what earlier documents or earlier places have, removed (ranges of code points, end exclusive).

    One row for each row of docs. Null texts stay null and have no units; nor have texts of fewer than least words. Rows
    that share a doc_id count as one document: they do not take units from each other, and each keeps its own first
    occurrence. Rows without an id are a document for each text, after all ids (under 2^62), in order of the texts' hashes.
    Other columns are not read; an empty table gives no rows.
    """
    tmp = Scratch(spark, "substring")
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(1 << 62)
    docs = small_batches(docs).select("doc_id", "text", F.coalesce("doc_id", unnamed).alias("doc"))
    keyed = docs.select("doc", "text")
    sown = tmp.save(keyed.mapInArrow(_emit_seeds, "seed bigint, same bigint, doc bigint"), "seeds")
    shared = sown.groupBy("seed").agg(F.min("same").alias("a"), F.max("same").alias("b")).filter("a < b").select("seed")
    near = sown.join(shared, "seed").groupBy("same").agg(F.min("doc").alias("doc"), F.collect_set("seed").alias("seeds"))
    near = tmp.save(near.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds")), "near")
    tmp.drop(sown)
    long = tmp.save(keyed.join(near, "doc").select("doc", "text", "seeds").mapInArrow(_emit_windows, "d1 bigint, d2 bigint, doc bigint"), "windows")
    tmp.drop(near)

    def late(of: DataFrame) -> DataFrame:
        first = of.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("d1", "d2", "first")
        return of.join(first, ["d1", "d2"]).filter("doc > first")

    windows = tmp.save(late(long).groupBy("doc").agg(F.collect_set("d1").alias("windows")), "late")
    tmp.drop(long)
    found = tmp.save(keyed.mapInArrow(_emit(least, sentences), "d1 bigint, d2 bigint, doc bigint"), "units")
    others = late(found).select("doc", F.struct("d1", "d2").alias("u")).distinct().groupBy("doc").agg(F.collect_list("u").alias("others"))
    others = tmp.finish(others.join(windows, "doc", "full"))
    rows = docs.join(others, "doc", "left")
    return rows.select("doc_id", "text", "others", "windows").mapInArrow(_cut(least, sentences), "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated passages, and what was removed from it."""
    out = dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), at.alias("removed"))
