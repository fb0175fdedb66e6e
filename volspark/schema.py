"""The canonical relation: a volume as rows (vol_id, z, y, x, v); one row per voxel of a dense grid."""

KEYS = ["vol_id", "z", "y", "x"]
AXES = ["z", "y", "x"]
VOXELS = "vol_id string, z int, y int, x int, v double"
#: replicate: edge value goes on; reflect: mirrored without the edge; symmetric: mirrored with it.
BOUNDARIES = ("replicate", "reflect", "symmetric")
