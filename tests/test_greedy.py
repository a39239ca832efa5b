"""Greedy choices by rounds against loops that go through rows one by one."""

import math
import random

import numpy as np
import pytest

from gridloom.operators import cells, cluster, greedy

BOX = "frame_id bigint, box_id bigint, x double, y double, length double, width double, yaw double, score double, class int"


def boxes(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), k, rng.uniform(0, 12), rng.uniform(-6, 6), rng.uniform(1, 5), rng.uniform(0.5, 2.5), rng.uniform(-4, 4), rng.choice([0.1, 0.5, 0.7, rng.random()]), rng.randrange(2)) for k in range(n)]
    return rows + [(0, 900, *rows[0][2:]), (0, 901, 1.0, 1.0, 2.0, 2.0, 0.0, 0.9, 0), (0, 902, 1.0, 1.0, 2.0, 2.0, math.pi / 2, 0.9, 0), (0, 903, 3.0, 1.0, 2.0, 2.0, 0.0, 0.9, 0), (1, 904, 500.0, 500.0, 40.0, 2.0, 0.4, 0.3, 1), (1, 905, 510.0, 503.0, 40.0, 2.0, 0.4, 0.2, 1), (1, 906, -3.0, -3.0, 0.0, 0.0, 0.0, 0.2, 1)]


def one_by_one(rows, threshold, before, after):
    kept = set()
    for key in {(r[0], r[8]) for r in rows}:
        own, keep = sorted((r for r in rows if (r[0], r[8]) == key), key=lambda r: (-r[7], r[1]))[:before], []
        for r in own:
            if len(keep) < after and all(cluster.rotated_iou(np.array(k[2:7]), np.array(r[2:7])) <= threshold + 1e-9 for k in keep):
                keep.append(r)
        kept |= {r[1] for r in keep}
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_suppression(spark, seed):
    rows = boxes(seed)
    df = spark.createDataFrame(rows, BOX)
    assert {r.box_id for r in cluster.suppress(df).collect()} == one_by_one(rows, 0.2, 1000, 83)
    assert {r.box_id for r in cluster.suppress(df, 0.05, 12, 4).collect()} == one_by_one(rows, 0.05, 12, 4)


def test_areas():
    rows = boxes(7, 60)
    a, b = (np.array([x[2:7] for x in pair]) for pair in zip(*((a, b) for k, a in enumerate(rows) for b in rows[:k]), strict=True))
    shared = cluster.shared_areas(a, b)
    for x, y, area in zip(a, b, shared, strict=True):
        union = x[2] * x[3] + y[2] * y[3] - area
        assert abs((area / union if union > 0 else 0.0) - cluster.rotated_iou(x, y)) < 1e-7


def test_no_boxes(spark):
    assert cluster.suppress(spark.createDataFrame([], BOX)).count() == 0


def test_long_chain(spark):
    """Each row is in conflict with the next: every second one is kept."""
    rows = [(g, k, k + 1) for g in (0, 1) for k in range(15 + g)]
    gone = greedy.losers(spark.createDataFrame(rows, "g int, better int, worse int"), ["g"])
    assert {tuple(r) for r in gone.collect()} == {(g, k) for g in (0, 1) for k in range(1, 16 + g, 2)}


def test_overlapping_cells(spark):
    rng = random.Random(3)
    rows = []
    for k in range(500):
        zone = rng.randrange(1, 5)
        size = (50, 100, 250, 500)[zone - 1]
        rows.append((rng.randrange(2), zone, size, rng.uniform(-3, 3), rng.uniform(-3, 3), f"c{rng.randrange(10**6):06d}", k))
    df = spark.createDataFrame(rows, "frame_id bigint, zone int, size_mm int, x double, y double, cell_id string, n bigint")
    want = set()
    for frame in (0, 1):
        taken = set()
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (r[1], r[2], r[5])):
            span = lambda c, h=r[2] / 2: range(int((c * 1000 - h + 1) // 50), int((c * 1000 + h - 1) // 50) + 1)
            own = {(a, b) for a in span(r[3]) for b in span(r[4])}
            if taken.isdisjoint(own):
                taken |= own
                want.add(r[6])
    assert {r.n for r in cells.resolve_overlaps(df).collect()} == want
