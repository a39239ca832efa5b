from collections import Counter

import numpy as np

from gridloom.operators import spatial
from gridloom.plans import terrain_queries as tq
from gridloom.plans.common import points

DIR = "/root/testdata/sf0.001"


def test_every_point_gives_its_leaf_its_cost(spark):
    """point_cost_containment against a comparison of every leaf with every point of its frame."""
    leaves, own = spatial.centres(tq._leaves(spark, DIR)).toPandas(), points(spark, DIR).toPandas()
    want: Counter = Counter()
    for frame, l in leaves.groupby("frame_id"):
        p, half = own[own.frame_id == frame], l.size_mm.to_numpy() / 2
        inside = lambda a, p=p, l=l, half=half: np.abs(l[a].to_numpy()[:, None] - p[a].to_numpy()[None, :]) <= half[:, None]
        cost = np.where((inside("x_mm") & inside("y_mm")).any(1), np.maximum(l.cost, 255), l.cost)
        want.update(zip(l.frame_id.tolist(), l.size_mm.tolist(), l.gx.tolist(), l.gy.tolist(), cost.tolist(), strict=True))
    assert Counter((r.frame_id, r.size_mm, r.gx, r.gy, r.cost) for r in tq.QUERIES["point_cost_containment"](spark, DIR).collect()) == want
