"""Cameras, bounding boxes, voxel grids and projections: one row per frame, box, voxel or point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmill.functions.vec import dot3, vec

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class BoxParams:
    # Default offset and span of the box around a plant, in mm.
    x_offset: float = 0.0
    y_offset: float = 0.0
    z_offset: float = -70.0
    x_span: float = 50.0
    y_span: float = 50.0
    z_span: float = 250.0


def camera_centres(frames: DataFrame) -> DataFrame:
    """plant_id, frame_idx, x, y, z: minus the transposed rotation times the translation."""
    t = vec("t1", "t2", "t3")
    out = [(-dot3(vec(f"r1{k}", f"r2{k}", f"r3{k}"), t) + 0.0).alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))]
    return frames.select("plant_id", "frame_idx", *out)


def pose_centroid(frames: DataFrame) -> DataFrame:
    """plant_id, x, y, z: mean camera centre."""
    return camera_centres(frames).groupBy("plant_id").agg(*(F.avg(c).alias(c) for c in "xyz"))


def bounding_boxes(frames: DataFrame, params: BoxParams = BoxParams()) -> DataFrame:
    """plant_id, origin ox oy oz and widths wx wy wz: centred below the cameras in x and y, hanging from them in z."""
    p = params
    return pose_centroid(frames).select(
        "plant_id", (F.col("x") - p.x_span / 2 + p.x_offset).alias("ox"), (F.col("y") - p.y_span / 2 + p.y_offset).alias("oy"), (F.col("z") - p.z_span + p.z_offset).alias("oz"),
        F.lit(p.x_span).alias("wx"), F.lit(p.y_span).alias("wy"), F.lit(p.z_span).alias("wz"),
    )


def _centres(grids: DataFrame, counts: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Slices are dealt over the session's shuffle partitions before they grow, so that few plants keep all cores busy."""
    parts = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ["plant_id", "k", *(c for c in keep if c == "frame_idx")]
    out = grids.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), counts[2] - 1))).repartition(parts, *dealt)
    for axis, n in zip("ij", counts, strict=False):
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = [(F.col(o) + (F.col(a) + 0.5) * F.col("voxel_size")).alias(c) for o, a, c in zip(("ox", "oy", "oz"), "ijk", "xyz", strict=True)]
    return out.select("plant_id", "i", "j", "k", *at, *keep)


def _sides() -> list[Column]:
    return [(F.floor(F.col(w) / F.col("voxel_size")) + 1).cast("long") for w in ("wx", "wy", "wz")]


def voxels_from_bbox(grids: DataFrame) -> DataFrame:
    """Voxel centres of boxes: floor(width / size) + 1 along each axis, the far end included."""
    return _centres(grids, _sides())


def voxels_from_dims(grids: DataFrame) -> DataFrame:
    """Voxel centres of grids with exactly nx, ny, nz voxels."""
    return _centres(grids, [F.col(n).cast("long") for n in ("nx", "ny", "nz")])


def grid_bounds(voxels: DataFrame, voxel_size: float) -> DataFrame:
    """plant_id, origin and widths of the box that a grid's voxels fill."""
    h = voxel_size / 2
    return voxels.groupBy("plant_id").agg(*(e for c in "xyz" for e in ((F.min(c) - h).alias(f"o{c}"), (F.max(c) - F.min(c) + voxel_size).alias(f"w{c}"))))


def project(points: DataFrame, frames: DataFrame, to_pixel: bool = True) -> DataFrame:
    """points x the frames of their plant, where the point is in front of the camera: sub-pixel u, v, or 1-based row, col.

    With to_pixel, points outside the sensor give no row. Points and frames are sorted and merged by plant, large plants split:
    Spark takes points that are made by generators for as few as the rows that they come from, and would send them to all tasks.
    """
    return _seen(points.join(frames.hint("merge"), "plant_id"), points.columns, to_pixel)


def project_voxels(grids: DataFrame, frames: DataFrame, to_pixel: bool = True) -> DataFrame:
    """`project` of the voxel centres of boxes, with plant_id, i, j, k: boxes meet their frames before they grow to voxels, which are never shuffled."""
    met = grids.join(frames.hint("merge"), "plant_id")
    keep = [c for c in frames.columns if c != "plant_id"]
    keys = ["plant_id", "i", "j", "k", *XYZ]
    return _seen(_centres(met, _sides(), tuple(keep)), keys, to_pixel).drop(*XYZ)


def _seen(met: DataFrame, keys: list[str], to_pixel: bool) -> DataFrame:
    """met(keys, x, y, z, ...) with the camera of a frame in each row: where the point lies in the frame."""
    p = vec(*XYZ)
    depth = dot3(vec("r31", "r32", "r33"), p) + F.col("t3")
    # A generator of one row keeps what it makes: the filters and columns after it do not compute it again.
    met = met.select("*", F.inline(F.array(F.struct(depth.alias("_d"))))).where("_d > 0")
    a = (dot3(vec("r11", "r12", "r13"), p) + F.col("t1")) / F.col("_d")
    b = (dot3(vec("r21", "r22", "r23"), p) + F.col("t2")) / F.col("_d")
    met = met.select("*", F.inline(F.array(F.struct(a.alias("_a"), b.alias("_b")))))
    a, b = F.col("_a"), F.col("_b")
    r2 = a * a + b * b
    radial = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
    u = F.col("fx") * (a * radial + 2 * F.col("p1") * a * b + F.col("p2") * (r2 + 2 * a * a)) + F.col("cx")
    v = F.col("fy") * (b * radial + F.col("p1") * (r2 + 2 * b * b) + 2 * F.col("p2") * a * b) + F.col("cy")
    met = met.select(*keys, "frame_idx", "width", "height", F.inline(F.array(F.struct(u.alias("u"), v.alias("v")))))
    if not to_pixel:
        return met.select(*keys, "frame_idx", "u", "v")
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    return met.where(inside).select(*keys, "frame_idx", (F.floor("v") + 1).cast("long").alias("row"), (F.floor("u") + 1).cast("long").alias("col"))


def clip_segments(segments: DataFrame) -> DataFrame:
    """Segments x1 y1 x2 y2 cut to xmin..xmax, ymin..ymax; those outside give no row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave, misses = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-dx, F.col("x1") - F.col("xmin")), (dx, F.col("xmax") - F.col("x1")), (-dy, F.col("y1") - F.col("ymin")), (dy, F.col("ymax") - F.col("y1"))):
        enter.append(F.when(p < 0, q / p).otherwise(0.0))
        leave.append(F.when(p > 0, q / p).otherwise(1.0))
        misses = misses | ((p == 0) & (q < 0))
    out = segments.withColumn("_0", F.greatest(*enter)).withColumn("_1", F.least(*leave)).where(~misses & (F.col("_0") <= F.col("_1")))
    kept = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2", "xmin", "xmax", "ymin", "ymax")]
    at = lambda o, d, t: o + F.col(t) * d
    return out.select(*kept, at(F.col("x1"), dx, "_0").alias("x1"), at(F.col("y1"), dy, "_0").alias("y1"), at(F.col("x1"), dx, "_1").alias("x2"), at(F.col("y1"), dy, "_1").alias("y2"))


def project_boxes(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """plant_id, frame_idx, edge, x1 y1 x2 y2: the 12 edges of each box in each image; an edge with a corner behind goes."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bit = lambda k: F.getbit("corner", F.lit(k))
    corners = boxes.withColumn("corner", corner).select("plant_id", "corner", *((F.col(f"o{c}") + bit(k) * F.col(f"w{c}")).alias(c) for k, c in enumerate("xyz")))
    seen = project(corners, frames, to_pixel=False).select("plant_id", "frame_idx", "corner", "u", "v")
    # An edge joins corners that differ in one bit; it is named by the lower corner and the bit.
    low = seen.withColumn("bit", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(F.shiftright("corner", 0).bitwiseAND(F.expr("shiftleft(1, bit)")) == 0)
    low = low.select("plant_id", "frame_idx", "corner", "bit", (F.col("corner") + F.expr("shiftleft(1, bit)")).alias("other"), F.col("u").alias("x1"), F.col("v").alias("y1"))
    high = seen.select("plant_id", "frame_idx", F.col("corner").alias("other"), F.col("u").alias("x2"), F.col("v").alias("y2"))
    edges = low.join(high, ["plant_id", "frame_idx", "other"]).join(frames.select("plant_id", "frame_idx", "width", "height"), ["plant_id", "frame_idx"])
    edges = edges.select("plant_id", "frame_idx", (F.col("corner") * 3 + F.col("bit")).alias("edge"), "x1", "y1", "x2", "y2", F.lit(0.0).alias("xmin"), F.col("width").cast("double").alias("xmax"), F.lit(0.0).alias("ymin"), F.col("height").cast("double").alias("ymax"))
    return clip_segments(edges)


def image_pairs(frames: DataFrame) -> DataFrame:
    """plant_id, a, b: each image with the next one, the last with the first; a single image has no pair."""
    w = Window.partitionBy("plant_id").orderBy("frame_idx")
    nxt = F.coalesce(F.lead("frame_idx").over(w), F.min("frame_idx").over(Window.partitionBy("plant_id")))
    return frames.select("plant_id", F.col("frame_idx").alias("a"), nxt.alias("b")).where("a <> b")


def all_pairs(frames: DataFrame) -> DataFrame:
    """plant_id, a, b: every unordered pair of images of a plant (the exhaustive matching list; a scan has tens of images)."""
    a, b = frames.select("plant_id", F.col("frame_idx").alias("a")), frames.select("plant_id", F.col("frame_idx").alias("b"))
    return a.join(b, "plant_id").where("a < b")


def pose_priors(cnc: DataFrame, registered: DataFrame, std: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Priors of registered images (position and diagonal covariance), and the images that are not registered."""
    keys = ["plant_id", "frame_idx"]
    priors = cnc.join(registered.select(*keys).distinct(), keys, "left_semi").select(*keys, "x", "y", "z", *(F.lit(s * s).alias(f"var_{c}") for c, s in zip("xyz", std, strict=True)))
    return priors, cnc.join(registered.select(*keys), keys, "left_anti").select(*keys)


def normalise_cameras(cameras: DataFrame) -> DataFrame:
    """Camera rows with model and params array<double> as k1, k2, p1, p2; another model gives nulls and an error text."""
    known = {"SIMPLE_RADIAL": 1, "RADIAL": 2, "OPENCV": 4}
    free = F.col("model").isin("SIMPLE_PINHOLE", "PINHOLE")
    out = []
    for k, name in enumerate(("k1", "k2", "p1", "p2")):
        value = F.when(free, F.lit(0.0))
        for model, n in known.items():
            value = value.when(F.col("model") == model, F.get("params", F.lit(4 + k - (model != "OPENCV"))) if k < n else F.lit(0.0))
        out.append(value.alias(name))
    bad = F.when(~free & ~F.col("model").isin(*known), F.concat(F.lit("unknown camera model "), F.col("model")))
    return cameras.select(*[c for c in cameras.columns if c != "params"], *out, bad.alias("error"))
