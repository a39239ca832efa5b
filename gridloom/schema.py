"""Column conventions.

A point is (frame_id, point_idx, x_mm, y_mm, z_mm, i_pct): integer millimetres in the vehicle frame (x ahead, y left), and
intensity in hundredths. Sums of integers do not depend on the order of rows, so aggregates are the same on any cluster.
point_idx is a point's place in its frame; what depends on order ranks by it.
"""

POINT = ["frame_id", "point_idx", "x_mm", "y_mm", "z_mm", "i_pct"]
XYZ = ["x_mm", "y_mm", "z_mm"]
