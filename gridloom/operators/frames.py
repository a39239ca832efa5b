"""Steps over whole frames in Arrow batches: many small frames in one call, as calls cost more than small frames do.

A frame is bounded by the sensor. What a task holds is a batch and the frame that goes on in the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Half of the 26 steps to the cells around one, so that each pair of cells is met once.
_STEPS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
#: Pairs that are compared at once.
_BLOCK = 1 << 21


def whole_frames(points: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, by: tuple[str, ...] = ("frame_id",), order: str = "point_idx") -> DataFrame:
    """work of tables of whole frames, in order of point_idx, with the number of each row's frame in the table.

    by and order: what else is to be whole, and in which order. The window that marks a frame's first row brings its rows
    together, in order, and needs no exchange if they are already."""
    marked = points.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        frames = np.cumsum(table["_first"].to_numpy()) - 1
        yield from work(table.drop_columns(["_first"]), frames).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                if any(b.num_rows for b in held):
                    yield from done(held)
                held = []
            held.append(batch.slice(starts[-1] if len(starts) else 0))  # its last frame waits for the next batch
        if any(b.num_rows for b in held):
            yield from done(held)

    return marked.mapInArrow(run, schema)


def fields(df: DataFrame) -> str:
    """The columns of df as a schema."""
    return ", ".join(f"`{k}` {t}" for k, t in df.dtypes)


def places(table: pa.Table, *axes: str) -> np.ndarray:
    """Columns as a matrix of floats, NaN where they are null."""
    return np.column_stack([table[c].to_pandas().to_numpy(float) for c in axes])


def near_blocks(xyz: np.ndarray, frames: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of points of a frame within eps once, in blocks; compared are those of neighbouring cells alone.

    Cells are found by a hash that a step adds a constant to. What it throws together is told apart by the cells themselves.
    """
    at = np.flatnonzero(np.isfinite(xyz).all(1))
    cells = np.floor(xyz[at] / eps).astype(np.int64)
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    key = (cells.astype(np.uint64) * odd[:3]).sum(1, dtype=np.uint64) + frames[at].astype(np.uint64) * odd[3]
    order = np.argsort(key, kind="stable")
    at, cells, key = at[order], cells[order], key[order]
    xyz, frames = xyz[at], frames[at]
    for step in [(0, 0, 0), *_STEPS]:
        sought = key + (np.array(step, np.int64).astype(np.uint64) * odd[:3]).sum(dtype=np.uint64)
        low = np.searchsorted(key, sought, "left") if any(step) else np.arange(1, len(key) + 1)
        ends = np.cumsum(np.maximum(np.searchsorted(key, sought, "right") - low, 0))
        begin = 0
        while begin < len(key):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
            many = np.diff(ends[begin:stop], prepend=done)
            i = np.repeat(np.arange(begin, stop), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[begin:stop], many)
            apart = xyz[i] - xyz[j]
            near = (frames[i] == frames[j]) & (cells[j] - cells[i] == step).all(1) & ((apart * apart).sum(1) <= eps * eps)
            yield at[i[near]], at[j[near]]
            begin = stop


def pair_blocks(frames: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of a frame once, the earlier row first, in blocks; a frame's rows stand together."""
    last = np.searchsorted(frames, frames, "right")
    many = last - np.arange(len(frames)) - 1
    ends, begin = np.cumsum(many), 0
    while begin < len(frames):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
        own = many[begin:stop]
        i = np.repeat(np.arange(begin, stop), own)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        begin = stop


def least_members(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of n, the least member of each one's component, for links between x and y."""
    root = np.arange(n)
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return root


def numbered(heads: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Of each row, how many heads its frame has up to it, less one; a frame's rows stand together."""
    up_to = np.cumsum(heads)
    start = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1))
    before = np.concatenate([[0], up_to])[start]
    return up_to - 1 - np.repeat(before, np.diff(start, append=len(frames)))


def nearest_distances(xyz: np.ndarray, frames: np.ndarray, k: int) -> np.ndarray:
    """Of each point, the squared distances to its k nearest other points of its frame, ascending; -1 where there are fewer.

    xyz: whole numbers; a frame's points stand together. Every pair of a frame is compared, frames of about as many points at once.
    """
    out = np.full((len(xyz), k), -1, np.int64)
    start = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1))
    size = np.diff(start, append=len(xyz))
    padded = (size + 7) // 8 * 8
    for s in np.unique(padded[size > 1]):
        own = np.flatnonzero((padded == s) & (size > 1))
        each = max(1, _BLOCK // int(s * s))
        for a in range(0, len(own), each):
            first, many = start[own[a : a + each]], size[own[a : a + each]]
            there = np.arange(s) < many[:, None]
            at = np.where(there, first[:, None] + np.arange(s), 0)
            p = xyz[at]
            for r in range(0, s, max(8, _BLOCK // int(s * len(first)))):
                rows = slice(r, r + max(8, _BLOCK // int(s * len(first))))
                d2 = sum((p[:, rows, None, c] - p[:, None, :, c]) ** 2 for c in range(3))
                left = np.iinfo(np.int64).max
                d2[np.broadcast_to(~there[:, None, :], d2.shape)] = left
                own_row = np.arange(s)[rows]
                d2[:, own_row - r, own_row] = left
                least = min(k, s)
                d2 = np.sort(np.partition(d2, least - 1, axis=2)[:, :, :least], axis=2)
                d2[d2 == left] = -1
                out[at[:, rows][there[:, rows]], :least] = d2[there[:, rows]]
    return out
