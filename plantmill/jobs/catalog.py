"""The queries of the plant jobs over the driver's tables, and the DuckDB SQL that says the same.

Each entry is one operator of the inventory on a derived table (`sources.tables`). Non-integer results are rounded in both.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmill.jobs import measurement, skeleton
from plantmill.operators import camera, components, curves, graph, image, measure, results, volume
from plantmill.sources import scans
from plantmill.sources.tables import COLS, FRAMES, ROWS, SIDE, load, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "v1_log_odds"
DIMS = (SIDE, SIDE, SIDE)


def query(needs: tuple[str, ...] = (), sql: str | None = None, select: bool = True) -> Callable:
    """Register a query by its function's name, with its oracle: SQL over the derived tables it needs."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.lstrip()
            prelude = with_clause(*needs) if needs else ""
            joined = body if not prelude else prelude + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLES[f.__name__] = joined.replace(prelude + ",\nRECURSIVE", "WITH RECURSIVE" + prelude[4:] + ",") if "RECURSIVE" in joined else joined
        return f

    return add


def r(c: str | Column, n: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + 0.0


def q(expr: str, n: int = 4) -> str:
    return f"(round({expr}, {n}) + 0.0)"


# Projection of p(x, y, z, ...) joined to frames, as SQL.
_CAM = """(r11 * x + r12 * y + r13 * z + t1) AS xc, (r21 * x + r22 * y + r23 * z + t2) AS yc, (r31 * x + r32 * y + r33 * z + t3) AS d"""
_SEEN = f"""WITH vox AS (SELECT plant_id, i, j, k, ox + (i + 0.5) * voxel_size AS x, oy + (j + 0.5) * voxel_size AS y, oz + (k + 0.5) * voxel_size AS z
  FROM grids, (SELECT unnest(range(0, {SIDE})) AS i), (SELECT unnest(range(0, {SIDE})) AS j), (SELECT unnest(range(0, {SIDE})) AS k)),
cam AS (SELECT v.*, f.* EXCLUDE (plant_id), {_CAM} FROM vox v JOIN frames f USING (plant_id)),
nrm AS (SELECT *, xc / d AS a, yc / d AS b FROM cam WHERE d > 0),
sub AS (SELECT *, fx * (a * (1 + k1 * (a*a+b*b) + k2 * (a*a+b*b) * (a*a+b*b)) + 2 * p1 * a * b + p2 * (a*a+b*b + 2*a*a)) + cx AS u, fy * (b * (1 + k1 * (a*a+b*b) + k2 * (a*a+b*b) * (a*a+b*b)) + p1 * (a*a+b*b + 2*b*b) + 2 * p2 * a * b) + cy AS v FROM nrm),
px AS (SELECT plant_id, i, j, k, frame_idx, floor(v)::BIGINT + 1 AS row, floor(u)::BIGINT + 1 AS col FROM sub WHERE u >= 0 AND u < width AND v >= 0 AND v < height)"""
_GREEN = f"(CASE WHEN r + g + b >= {127 / 255!r} AND r + g + b > 0 THEN g / (r + g + b) ELSE 0.0 END)"
_MASK = f"SELECT plant_id, frame_idx, row, col FROM pixels WHERE {_GREEN} > 0.3"
_COUNTS = f"""{_SEEN}, msk AS ({_MASK}),
counts AS (SELECT v.plant_id, v.i, v.j, v.k, count(p.frame_idx) AS seen, count(m.row) AS hits FROM vox v LEFT JOIN px p USING (plant_id, i, j, k) LEFT JOIN msk m ON m.plant_id = p.plant_id AND m.frame_idx = p.frame_idx AND m.row = p.row AND m.col = p.col GROUP BY ALL)"""
_P = volume.VoteParams()
_HIT, _MISS, _PRIOR = math.log(_P.tpr / _P.fpr), math.log((1 - _P.tpr) / (1 - _P.fpr)), math.log(_P.prior / (1 - _P.prior))
_LOD = f"{_COUNTS}, lod AS MATERIALIZED (SELECT plant_id, i, j, k, {_PRIOR!r} + hits * {_HIT!r} + (seen - hits) * {_MISS!r} AS lod FROM counts)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "frames")


def voxels(spark: SparkSession, d: str) -> DataFrame:
    return camera.voxels_from_bbox(load(spark, d, "grids"))


def green_mask(spark: SparkSession, d: str) -> DataFrame:
    return image.threshold(image.green_index(load(spark, d, "pixels")), 0.3)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return volume.vote_counts(load(spark, d, "grids"), frames(spark, d), green_mask(spark, d))


# --- cameras, boxes, grids, projections


@query(("frames",), f"SELECT plant_id, frame_idx, {q('-(r11*t1+r21*t2+r31*t3)', 6)} AS x, {q('-(r12*t1+r22*t2+r32*t3)', 6)} AS y, {q('-(r13*t1+r23*t2+r33*t3)', 6)} AS z FROM frames")
def p1_camera_centres(spark: SparkSession, d: str) -> DataFrame:
    return camera.camera_centres(frames(spark, d)).select("plant_id", "frame_idx", *(r(c, 6).alias(c) for c in "xyz"))


@query(("frames",), f"SELECT plant_id, {q('avg(-(r11*t1+r21*t2+r31*t3))')} AS x, {q('avg(-(r12*t1+r22*t2+r32*t3))')} AS y, {q('avg(-(r13*t1+r23*t2+r33*t3))')} AS z FROM frames GROUP BY plant_id")
def a1_pose_centroid(spark: SparkSession, d: str) -> DataFrame:
    return camera.pose_centroid(frames(spark, d)).select("plant_id", *(r(c).alias(c) for c in "xyz"))


@query(("frames",), f"""SELECT plant_id, {q('x - 25.0')} AS ox, {q('y - 25.0')} AS oy, {q('z - 250.0 - 70.0')} AS oz, 50.0::DOUBLE AS wx, 50.0::DOUBLE AS wy, 250.0::DOUBLE AS wz
  FROM (SELECT plant_id, avg(-(r11*t1+r21*t2+r31*t3)) AS x, avg(-(r12*t1+r22*t2+r32*t3)) AS y, avg(-(r13*t1+r23*t2+r33*t3)) AS z FROM frames GROUP BY plant_id)""")
def p2_bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return camera.bounding_boxes(frames(spark, d)).select("plant_id", *(r(c).alias(c) for c in ("ox", "oy", "oz", "wx", "wy", "wz")))


@query(("grids",), f"""SELECT plant_id, i, j, k, ox + (i + 0.5) * voxel_size AS x, oy + (j + 0.5) * voxel_size AS y, oz + (k + 0.5) * voxel_size AS z
  FROM grids, (SELECT unnest(range(0, {SIDE})) AS i), (SELECT unnest(range(0, {SIDE})) AS j), (SELECT unnest(range(0, {SIDE})) AS k)""")
def p3_voxel_grid(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d)


@query(("grids",), "SELECT plant_id, ox, wx + 1 AS wx, oy, wy + 1 AS wy, oz, wz + 1 AS wz FROM grids")
def p4_grid_bounds(spark: SparkSession, d: str) -> DataFrame:
    return camera.grid_bounds(voxels(spark, d), 1.0)


@query(("frames", "grids"), f"{_SEEN} SELECT plant_id, i, j, k, frame_idx, {q('u')} AS u, {q('v')} AS v FROM sub")
def p5_project(spark: SparkSession, d: str) -> DataFrame:
    return camera.project_voxels(load(spark, d, "grids"), frames(spark, d), to_pixel=False).select("plant_id", "i", "j", "k", "frame_idx", r("u").alias("u"), r("v").alias("v"))


@query(("frames", "grids"), f"{_SEEN} SELECT plant_id, i, j, k, frame_idx, row, col FROM px")
def p6_pixels(spark: SparkSession, d: str) -> DataFrame:
    return camera.project_voxels(load(spark, d, "grids"), frames(spark, d)).select("plant_id", "i", "j", "k", "frame_idx", "row", "col")


_SEG = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 60 AS DOUBLE) AS y1, CAST(l_suppkey % 80 AS DOUBLE) - 20 AS x2, CAST(l_orderkey % 70 AS DOUBLE) - 15 AS y2 FROM lineitem"


@query((), f"""WITH s AS ({_SEG}), e AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s),
 t AS (SELECT *, greatest(0.0, CASE WHEN -dx < 0 THEN (x1 - 5.0) / -dx ELSE 0.0 END, CASE WHEN dx < 0 THEN (40.0 - x1) / dx ELSE 0.0 END, CASE WHEN -dy < 0 THEN (y1 - 5.0) / -dy ELSE 0.0 END, CASE WHEN dy < 0 THEN (40.0 - y1) / dy ELSE 0.0 END) AS t0,
  least(1.0, CASE WHEN -dx > 0 THEN (x1 - 5.0) / -dx ELSE 1.0 END, CASE WHEN dx > 0 THEN (40.0 - x1) / dx ELSE 1.0 END, CASE WHEN -dy > 0 THEN (y1 - 5.0) / -dy ELSE 1.0 END, CASE WHEN dy > 0 THEN (40.0 - y1) / dy ELSE 1.0 END) AS t1 FROM e WHERE NOT (dx = 0 AND (x1 < 5 OR x1 > 40)) AND NOT (dy = 0 AND (y1 < 5 OR y1 > 40)))
 SELECT l_orderkey, l_linenumber, {q('x1 + dx * t0')} AS x1, {q('y1 + dy * t0')} AS y1, {q('x1 + dx * t1')} AS x2, {q('y1 + dy * t1')} AS y2 FROM t WHERE t0 <= t1""")
def p7_clip_segments(spark: SparkSession, d: str) -> DataFrame:
    s = spark.sql(_SEG.replace("FROM lineitem", "FROM {t}"), t=load(spark, d, "lineitem"))
    s = s.withColumns({"xmin": F.lit(5.0), "xmax": F.lit(40.0), "ymin": F.lit(5.0), "ymax": F.lit(40.0)})
    return camera.clip_segments(s).select("l_orderkey", "l_linenumber", *(r(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query((), "SELECT c_custkey, CASE WHEN m IN ('SIMPLE_PINHOLE','PINHOLE') THEN 0.0 WHEN m IN ('SIMPLE_RADIAL','RADIAL') THEN c_custkey / 100.0 + 3 WHEN m = 'OPENCV' THEN c_custkey / 100.0 + 4 END AS k1, CASE WHEN m IN ('SIMPLE_PINHOLE','PINHOLE','SIMPLE_RADIAL') THEN 0.0 WHEN m = 'RADIAL' THEN c_custkey / 100.0 + 4 WHEN m = 'OPENCV' THEN c_custkey / 100.0 + 5 END AS k2, CASE WHEN m = 'OPENCV' THEN c_custkey / 100.0 + 6 WHEN m <> 'FISHEYE' THEN 0.0 END AS p1, CASE WHEN m = 'OPENCV' THEN c_custkey / 100.0 + 7 WHEN m <> 'FISHEYE' THEN 0.0 END AS p2, CASE WHEN m = 'FISHEYE' THEN 'unknown camera model FISHEYE' END AS error FROM (SELECT c_custkey, ['SIMPLE_PINHOLE','PINHOLE','SIMPLE_RADIAL','RADIAL','OPENCV','FISHEYE'][c_custkey % 6 + 1] AS m FROM customer)")
def s5_camera_models(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*map(F.lit, ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "FISHEYE")))
    rows = load(spark, d, "customer").select("c_custkey", F.get(models, (F.col("c_custkey") % 6).cast("int")).alias("model"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("c_custkey") / 100.0 + k).alias("params"))
    return camera.normalise_cameras(rows).drop("model")


@query(("frames",), "SELECT plant_id, a, b FROM (SELECT plant_id, frame_idx AS a, coalesce(lead(frame_idx) OVER w, min(frame_idx) OVER (PARTITION BY plant_id)) AS b FROM frames WINDOW w AS (PARTITION BY plant_id ORDER BY frame_idx)) WHERE a <> b")
def j3_image_pairs(spark: SparkSession, d: str) -> DataFrame:
    return camera.image_pairs(frames(spark, d))


@query(("frames",), "SELECT x.plant_id, x.frame_idx AS a, y.frame_idx AS b FROM frames x JOIN frames y ON x.plant_id = y.plant_id AND x.frame_idx < y.frame_idx")
def j4_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return camera.all_pairs(frames(spark, d))


@query(("images",), "SELECT plant_id, frame_idx, x, y, z, 4.0::DOUBLE AS var_x, 4.0::DOUBLE AS var_y, 9.0::DOUBLE AS var_z, has_pose = 1 AS registered FROM images WHERE has_pose = 1 UNION ALL SELECT plant_id, frame_idx, NULL, NULL, NULL, NULL, NULL, NULL, false FROM images WHERE has_pose = 0")
def j5_pose_priors(spark: SparkSession, d: str) -> DataFrame:
    images = load(spark, d, "images")
    priors, missing = camera.pose_priors(images, images.where("has_pose = 1"), (2.0, 2.0, 3.0))
    return priors.withColumn("registered", F.lit(True)).unionByName(missing.withColumn("registered", F.lit(False)), allowMissingColumns=True)


@query(("images",), "SELECT plant_id, count(*) AS n_images, count(*) FILTER (has_pose = 0) AS n_missing, count(*) > 0 AND count(*) FILTER (has_pose = 0) = 0 AS valid FROM images GROUP BY plant_id")
def s2_valid_scans(spark: SparkSession, d: str) -> DataFrame:
    return scans.validity(*listed(spark, d)).withColumn("plant_id", F.col("plant_id").cast("long"))


def listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The images of scan folders with an image a row, and the paths of their metadata."""
    own = load(spark, d, "images")
    return scans.image_list(own.select(in_folder("images", F.lit("jpg")))), own.where("has_pose = 1").select(in_folder("metadata/images", F.lit("json")))


def in_folder(folder: str, suffix: Column) -> Column:
    return F.concat(F.lit("file:/data/field/"), "plant_id", F.lit(f"/{folder}/"), F.format_string("%05d_rgb.", "frame_idx"), suffix).alias("path")


@query(("images",), "SELECT 'experiment' AS kind, plant_id::VARCHAR AS plant_id FROM images GROUP BY plant_id HAVING count(*) FILTER (has_pose = 0) = 0")
def s1_scan_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The valid scans of a folder of scans."""
    own, meta = listed(spark, d)
    paths = load(spark, d, "images").select(in_folder("images", F.lit("jpg")))
    return scans.folder_kind(paths, scans.validity(own, meta).where("valid"), "/data/field/")


@query(("images",), "SELECT plant_id::VARCHAR AS plant_id, row_number() OVER (PARTITION BY plant_id ORDER BY frame_idx) AS frame_idx, x, y, z FROM images QUALIFY has_pose = 1")
def s3_cnc_poses(spark: SparkSession, d: str) -> DataFrame:
    """Poses out of the JSON text of each image; images without one are not listed."""
    text = F.to_json(F.struct(F.array("x", "y", "z", F.lit(0.0)).alias("approximate_pose"), F.lit("rgb").alias("channel")))
    texts = load(spark, d, "images").where("has_pose = 1").select(in_folder("metadata/images", F.lit("json")), text.alias("value"))
    return scans.poses_in(texts, listed(spark, d)[0]).select("plant_id", "frame_idx", "x", "y", "z")


_POSE = [f"r{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3)] + ["t1", "t2", "t3"]
_LENS = ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"]


@query(("frames",), f"SELECT plant_id::VARCHAR AS plant_id, frame_idx, {', '.join(f'{c} + 0.0 AS {c}' for c in _POSE)}, width, height, {', '.join(_LENS)} FROM frames")
def s4_camera_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames out of the JSON texts of cameras and poses, a file of each kind a plant."""
    own = frames(spark, d)
    folder = lambda name: F.concat(F.lit("file:/data/field/"), "plant_id", F.lit(f"/{name}")).alias("path")
    camera_of = F.struct("width", "height", F.lit("OPENCV").alias("model"), F.array(*_LENS).alias("params"))
    cameras = own.groupBy("plant_id").agg(F.first(camera_of).alias("c")).select(folder("cameras.json"), F.to_json(F.create_map(F.lit("1"), "c")).alias("value"))
    pose = F.struct(F.array(*(F.array(*(f"r{a}{b}" for b in (1, 2, 3))) for a in (1, 2, 3))).alias("rotmat"), F.array("t1", "t2", "t3").alias("tvec"))
    named = F.struct(F.format_string("%05d_rgb.jpg", "frame_idx"), pose)
    poses = own.groupBy("plant_id").agg(F.map_from_entries(F.collect_list(named)).alias("m")).select(folder("images.json"), F.to_json("m").alias("value"))
    return scans.frames_in(cameras, poses, scans.image_list(own.select(in_folder("images", F.lit("jpg"))))).drop("img_name")


@query(("grids", "frames"), f"SELECT plant_id::VARCHAR AS plant_id, ox, oy, oz, wx, wy, wz, voxel_size, CASE plant_id % 3 WHEN 0 THEN 'carving' WHEN 1 THEN 'counting' ELSE 'averaging' END AS method, {FRAMES} - CASE WHEN plant_id % 2 = 0 THEN 1 ELSE 2 END AS threshold FROM grids")
def s7_voxel_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Grids out of JSON text: ends in any order, a type or a method or neither, a number of images that may miss or none."""
    kind, even = F.col("plant_id") % 3, F.col("plant_id") % 2 == 0
    box = F.struct(*(F.array(F.col(f"o{c}") + F.col(f"w{c}"), f"o{c}").alias(c) for c in "xyz"))
    task = F.struct(box.alias("bounding_box"), "voxel_size", F.when(kind == 0, "carving").alias("type"), F.when(kind == 0, "other").when(kind == 1, "counting").alias("method"), F.when(even, 1).alias("missing_images_threshold"))
    texts = load(spark, d, "grids").select(F.concat(F.lit("file:/data/field/"), "plant_id", F.lit("/metadata/Voxels_1.json")).alias("path"), F.to_json(F.struct(task.alias("task_params"))).alias("value"))
    return scans.voxels_in(texts, scans.image_list(frames(spark, d).select(in_folder("images", F.lit("jpg")))))


@query(("pixels",), f"SELECT a.plant_id, a.frame_idx, y.row, x.col, coalesce(round(p.r * 255), 0) / 255 AS r, coalesce(round(p.g * 255), 0) / 255 AS g, coalesce(round(p.b * 255), 0) / 255 AS b FROM (SELECT DISTINCT plant_id, frame_idx FROM pixels) a, (SELECT unnest(range(1, {ROWS + 1})) AS row) y, (SELECT unnest(range(1, {COLS + 1})) AS col) x LEFT JOIN pixels p ON p.plant_id = a.plant_id AND p.frame_idx = a.frame_idx AND p.row = y.row AND p.col = x.col")
def s6_image_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels out of image bytes (rows of blue, green, red); where the table has none the byte is 0."""
    at = ((F.col("row") - 1) * COLS + F.col("col") - 1).cast("int")
    colour = F.concat(*(F.lpad(F.hex(F.round(F.col(c) * 255).cast("long")), 2, "0") for c in "bgr"))
    entry = F.array_sort(F.collect_list(F.struct(at.alias("at"), colour.alias("colour"))))
    whole = load(spark, d, "pixels").groupBy("plant_id", "frame_idx").agg(entry.alias("m"))
    # Each pixel after the black ones since the one before it: one pass, whatever the number of pixels.
    black = lambda n: F.repeat(F.lit("000000"), n)
    filled = F.transform("m", lambda e, k: F.concat(black(e["at"] - F.coalesce(F.get("m", k - 1)["at"], F.lit(-1)) - 1), F.coalesce(e["colour"], F.lit("000000"))))
    data = F.unhex(F.concat(F.array_join(filled, ""), black(ROWS * COLS - 1 - F.element_at("m", -1)["at"])))
    rows = whole.select("plant_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(ROWS).alias("height"), F.lit(COLS).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return scans.decoded(rows)


# --- images and masks


def _index(name: str, op: Callable[[DataFrame], DataFrame], value: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return op(load(spark, d, "pixels")).select("plant_id", "frame_idx", "row", "col", r("feat", 6).alias("feat"))

    run.__name__ = name
    query(("pixels",), f"SELECT plant_id, frame_idx, row, col, {q(f'CASE WHEN r + g + b >= {127 / 255!r} AND r + g + b > 0 THEN ({value}) / (r + g + b) ELSE 0.0 END', 6)} AS feat FROM pixels")(run)


_index("p9_green_index", image.green_index, "g")
_index("p10_red_index", image.red_index, "r + b / 2.4")
_index("p11_green_minus_red_index", image.green_minus_red_index, "g + 1.4 * b / 5.4")


@query(("pixels",), _MASK)
def p12_mask(spark: SparkSession, d: str) -> DataFrame:
    return green_mask(spark, d)


@query(("pixels",), "SELECT plant_id, frame_idx, row, col, round((0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE * 255) / 255 AS feat FROM pixels")
def i2_grey(spark: SparkSession, d: str) -> DataFrame:
    return image.grey(load(spark, d, "pixels"))


_DIAMOND = "(VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(a, b)"


@query(("pixels",), f"WITH m AS ({_MASK}) SELECT DISTINCT plant_id, frame_idx, row + a AS row, col + b AS col FROM m, {_DIAMOND} WHERE row + a BETWEEN 1 AND {ROWS} AND col + b BETWEEN 1 AND {COLS}")
def i9_dilate(spark: SparkSession, d: str) -> DataFrame:
    return image.dilate(green_mask(spark, d), 3, ROWS, COLS)


# Pixels of a sparser mask, so that components stay apart; labelled by recursion in SQL.
_SPARSE = f"SELECT plant_id, frame_idx, row, col FROM pixels WHERE {_GREEN} > 0.62"
_LABELS = f"""WITH RECURSIVE m AS MATERIALIZED ({_SPARSE}),
e AS MATERIALIZED (SELECT a.*, b.row AS row2, b.col AS col2 FROM m a JOIN m b ON a.plant_id = b.plant_id AND a.frame_idx = b.frame_idx AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach AS (SELECT plant_id, frame_idx, row, col, row AS r0, col AS c0 FROM m UNION SELECT e.plant_id, e.frame_idx, e.row2, e.col2, r0, c0 FROM reach JOIN e USING (plant_id, frame_idx, row, col)),
lab AS (SELECT plant_id, frame_idx, row, col, min(r0 * 1000 + c0) AS label FROM reach GROUP BY ALL),
siz AS (SELECT plant_id, frame_idx, label, count(*) AS size FROM lab GROUP BY ALL)"""


def sparse_mask(spark: SparkSession, d: str) -> DataFrame:
    return image.threshold(image.green_index(load(spark, d, "pixels")), 0.62)


@query(("pixels",), f"{_LABELS} SELECT plant_id, frame_idx, row, col, label FROM lab")
def c1_components(spark: SparkSession, d: str) -> DataFrame:
    out = components.cell_components(sparse_mask(spark, d), image.KEYS, ["row", "col"])
    return out.select("plant_id", "frame_idx", "row", "col", (F.col("label.row") * 1000 + F.col("label.col")).alias("label"))


@query(("pixels",), f"{_LABELS} SELECT plant_id, frame_idx, label, size FROM siz")
def a4_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = components.component_sizes(components.cell_components(sparse_mask(spark, d), image.KEYS, ["row", "col"]), image.KEYS)
    return out.select("plant_id", "frame_idx", (F.col("label.row") * 1000 + F.col("label.col")).alias("label"), "size")


@query(("pixels",), f"{_LABELS} SELECT plant_id, frame_idx, row, col FROM lab JOIN siz USING (plant_id, frame_idx, label) WHERE size >= 3")
def i7_remove_small(spark: SparkSession, d: str) -> DataFrame:
    return components.remove_small(sparse_mask(spark, d), image.KEYS, ["row", "col"], 3)


@query(("pixels",), f"{_LABELS}, best AS (SELECT plant_id, frame_idx, label FROM siz QUALIFY row_number() OVER (PARTITION BY plant_id, frame_idx ORDER BY size DESC, label) = 1) SELECT plant_id, frame_idx, row, col FROM lab SEMI JOIN best USING (plant_id, frame_idx, label)")
def i8_keep_largest(spark: SparkSession, d: str) -> DataFrame:
    return components.keep_largest(sparse_mask(spark, d), image.KEYS, ["row", "col"])


@query(("pixels",), f"{_LABELS}, big AS (SELECT plant_id, frame_idx, row, col FROM lab JOIN siz USING (plant_id, frame_idx, label) WHERE size >= 2) SELECT DISTINCT plant_id, frame_idx, row + a AS row, col + b AS col FROM big, {_DIAMOND} WHERE row + a BETWEEN 1 AND {ROWS} AND col + b BETWEEN 1 AND {COLS}")
def i10_mask(spark: SparkSession, d: str) -> DataFrame:
    return image.mask(image.green_index(load(spark, d, "pixels")), 0.62, 2, 3, ROWS, COLS)


@query(("pixels", "frames"), f"SELECT plant_id, {q('coalesce(n, 0) / area::DOUBLE', 6)} AS coverage FROM (SELECT plant_id, sum(width * height) AS area FROM frames GROUP BY 1) LEFT JOIN (SELECT plant_id, count(*) AS n FROM ({_MASK}) GROUP BY 1) USING (plant_id)")
def a5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return image.coverage(green_mask(spark, d), frames(spark, d)).select("plant_id", r("coverage", 6).alias("coverage"))


def _opened(op: str, source: str, sign: str, offsets: list[tuple[int, int]]) -> str:
    values, back = ", ".join(f"({a}, {b})" for a, b in [(0, 0), *offsets]), "-" if sign == "+" else "+"
    moved = f"SELECT plant_id, frame_idx, row {back} a AS row, col {back} b AS col, feat FROM {source}, (VALUES {values}) o(a, b)"
    return f"(SELECT plant_id, frame_idx, row, col, {op}(feat) AS feat FROM ({moved}) SEMI JOIN {source} USING (plant_id, frame_idx, row, col) GROUP BY ALL)"


# One half of each line of half-length 2, by 22.5 degrees from level up; the other half is its mirror.
_HALVES = (
    ((0, 1), (0, 2)), ((1, 1), (1, 2)), ((1, 1), (2, 2)), ((1, 1), (2, 1)),
    ((1, 0), (2, 0)), ((1, -1), (2, -1)), ((1, -1), (2, -2)), ((1, -1), (1, -2)),
)
_LINES = [[*h, *((-a, -b) for a, b in h)] for h in _HALVES]
_GREY = "WITH grey AS MATERIALIZED (SELECT plant_id, frame_idx, row, col, round((0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE * 255) / 255 AS feat FROM pixels)"


@query(("pixels",), f"{_GREY}, er AS MATERIALIZED {_opened('min', 'grey', '+', _LINES[2])} SELECT plant_id, frame_idx, row, col, feat FROM {_opened('max', 'er', '-', _LINES[2])}")
def i4_opening(spark: SparkSession, d: str) -> DataFrame:
    return image.opening(image.grey(load(spark, d, "pixels")), image.line_element(2, math.pi / 4))


_BOX = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
_THIN = _GREY + "".join(f", e{k} AS MATERIALIZED {_opened('min', 'grey', '+', o)}, o{k} AS MATERIALIZED {_opened('max', f'e{k}', '-', o)}" for k, o in enumerate([*_LINES, _BOX]))
_JOINED = "o0" + "".join(f" JOIN o{k} USING (plant_id, frame_idx, row, col)" for k in range(1, 9))


@query(("pixels",), f"{_THIN} SELECT plant_id, frame_idx, row, col, {q('greatest(' + ', '.join(f'o{k}.feat' for k in range(8)) + ') - o8.feat', 6)} AS feat FROM {_JOINED}")
def i5_thin_lines(spark: SparkSession, d: str) -> DataFrame:
    return image.thin_lines(image.grey(load(spark, d, "pixels")), 2).select("plant_id", "frame_idx", "row", "col", r("feat", 6).alias("feat"))


def _blurred(source: str, axis: str) -> str:
    w = ", ".join(f"({k}, {math.exp(-k * k / 2.0)!r}::DOUBLE)" for k in range(-2, 3))
    other = "col" if axis == "row" else "row"
    return f"(SELECT f.plant_id, f.frame_idx, f.row, f.col, sum(w * g.feat) / sum(w) AS feat FROM {source} f, (VALUES {w}) o(k, w), {source} g WHERE g.plant_id = f.plant_id AND g.frame_idx = f.frame_idx AND g.{other} = f.{other} AND g.{axis} = f.{axis} - k GROUP BY ALL)"


@query(("pixels",), f"{_GREY}, one AS MATERIALIZED {_blurred('grey', 'row')} SELECT plant_id, frame_idx, row, col, {q('feat')} AS feat FROM {_blurred('one', 'col')}")
def i1_blur(spark: SparkSession, d: str) -> DataFrame:
    return image.blur(image.grey(load(spark, d, "pixels")), 1.0).select("plant_id", "frame_idx", "row", "col", r("feat").alias("feat"))


_SOFT = "WITH " + ", ".join(f"c{c} AS (SELECT plant_id, frame_idx, row, col, {c} AS feat FROM pixels), d{c} AS MATERIALIZED {_blurred(f'c{c}', 'row')}, b{c} AS MATERIALIZED {_blurred(f'd{c}', 'col')}" for c in "rgb") + ", soft AS (SELECT plant_id, frame_idx, row, col, br.feat AS r, bg.feat AS g, bb.feat AS b FROM br JOIN bg USING (plant_id, frame_idx, row, col) JOIN bb USING (plant_id, frame_idx, row, col))"


@query(("pixels",), f"{_SOFT} SELECT plant_id, frame_idx, row, col, {q(f'round({_GREEN} * 255) / 255', 6)} AS feat FROM soft")
def i6_features(spark: SparkSession, d: str) -> DataFrame:
    """The green index of blurred images, on the grid of 1/255."""
    return image.features(load(spark, d, "pixels"), image.MaskParams(use_line=False, sigma=1.0)).select("plant_id", "frame_idx", "row", "col", r("feat", 6).alias("feat"))


@query(("pixels",), f"WITH m AS (SELECT plant_id, frame_idx, row, col, 1 AS step FROM pixels WHERE round({_GREEN} * 255) / 255 > 0.4 UNION ALL SELECT plant_id, frame_idx, row, col, 2 FROM pixels WHERE round({_GREEN.replace(repr(127 / 255), '1.5')} * 255) / 255 > 0.4) SELECT DISTINCT step, plant_id, frame_idx, row + a AS row, col + b AS col FROM m, {_DIAMOND} WHERE row + a BETWEEN 1 AND {ROWS} AND col + b BETWEEN 1 AND {COLS}")
def i11_changed_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks after a change of the threshold, which keeps the features, and after one of the least brightness, which does not."""
    pixels, old = load(spark, d, "pixels"), image.MaskParams(use_line=False, t=0.3)
    feats, out = image.features(pixels, old), []
    for step, new in ((1, replace(old, t=0.4)), (2, replace(old, t=0.4, least=1.5))):
        out.append(image.frame_masks(image.changed_features(feats, pixels, old, new), new, ROWS, COLS).withColumn("step", F.lit(step)))
    return out[0].unionByName(out[1])


# --- votes and volumes


@query(("pixels", "frames", "grids"), f"{_COUNTS} SELECT plant_id, i, j, k, seen, hits FROM counts")
def j2_vote_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


@query(("pixels", "frames", "grids"), f"{_LOD} SELECT plant_id, i, j, k, {q('lod', 6)} AS lod FROM lod")
def v1_log_odds(spark: SparkSession, d: str) -> DataFrame:
    return volume.log_odds(counts(spark, d)).select("plant_id", "i", "j", "k", r("lod", 6).alias("lod"))


@query(("pixels", "frames", "grids"), f"{_COUNTS} SELECT plant_id, i, j, k, {q(f'{math.log(0.1 / 0.9)!r} + hits * {math.log(0.9 / 0.2)!r} + (seen - hits) * {math.log((1 - 0.9) / (1 - 0.2))!r}', 6)} AS lod FROM counts")
def v2_other_rates(spark: SparkSession, d: str) -> DataFrame:
    return volume.log_odds(counts(spark, d), volume.VoteParams(0.1, 0.9, 0.2)).select("plant_id", "i", "j", "k", r("lod", 6).alias("lod"))


@query(("pixels", "frames", "grids"), f"{_LOD} SELECT plant_id, i, j, k FROM lod WHERE lod > 0.5")
def p13_occupied(spark: SparkSession, d: str) -> DataFrame:
    return volume.occupied(volume.log_odds(counts(spark, d)), 0.5)


@query(("frames",), f"SELECT plant_id, n AS frames, {q(f'{_PRIOR!r} + n * {_MISS!r}')} AS low, {q(f'{_PRIOR!r} + n * {_HIT!r}')} AS high, {q(f'1 / (1 + exp(-({_PRIOR!r} + n * {_HIT!r})))')} AS p_high FROM (SELECT plant_id, count(*) AS n FROM frames GROUP BY 1)")
def p14_bounds(spark: SparkSession, d: str) -> DataFrame:
    return volume.bounds(frames(spark, d)).select("plant_id", "frames", r("low").alias("low"), r("high").alias("high"), r(volume.probability(F.col("high"))).alias("p_high"))


@query(("pixels", "frames", "grids"), f"{_LOD} SELECT plant_id, count(*) AS voxels, count(*) FILTER (lod > 0.5) AS occupied, {q('max(lod)')} AS max_lod FROM lod GROUP BY plant_id")
def v7_voxel_counts(spark: SparkSession, d: str) -> DataFrame:
    return volume.voxel_counts(volume.log_odds(counts(spark, d)), 0.5).select("plant_id", "voxels", "occupied", r("max_lod").alias("max_lod"))


_EDGES = f"""nb AS MATERIALIZED (SELECT plant_id, i, j, k, lod, ((plant_id * {SIDE} + i) * {SIDE} + j) * {SIDE} + k AS n, ((plant_id * {SIDE} + i + p) * {SIDE} + j + q) * {SIDE} + k + s AS m FROM lod, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(p, q, s)
  WHERE i + p BETWEEN 0 AND {SIDE - 1} AND j + q BETWEEN 0 AND {SIDE - 1} AND k + s BETWEEN 0 AND {SIDE - 1}),
ed AS MATERIALIZED (SELECT a.plant_id, a.i, a.j, a.k, a.n, a.m, exp(-pow((a.lod - b.lod) / 10.0, 2)) AS w, a.lod AS x1, b.lod AS x2 FROM nb a JOIN (SELECT DISTINCT n, lod FROM nb) b ON b.n = a.m)"""


@query(("pixels", "frames", "grids"), f"{_LOD}, {_EDGES} SELECT plant_id, i, j, k, count(*) AS n, {q('sum(w)')} AS diag FROM ed GROUP BY ALL")
def v3_gmrf_diagonal(spark: SparkSession, d: str) -> DataFrame:
    e = volume.gmrf_edges(volume.log_odds(counts(spark, d)), 10.0)
    return e.groupBy("plant_id", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("diag")).select("plant_id", "u.i", "u.j", "u.k", "n", r("diag").alias("diag"))


@query(("pixels", "frames", "grids"), f"{_LOD}, {_EDGES} SELECT plant_id, i, j, k, {q('sum(w * (x1 - x2))')} AS lx FROM ed GROUP BY ALL")
def v4_laplacian(spark: SparkSession, d: str) -> DataFrame:
    lod = volume.log_odds(counts(spark, d))
    x = lod.select("plant_id", F.struct("i", "j", "k").alias("u"), F.col("lod").alias("x"))
    return volume.laplacian(volume.gmrf_edges(lod, 10.0), x).select("plant_id", "u.i", "u.j", "u.k", r("lx").alias("lx"))


def _solved(steps: list[tuple[float, float]]) -> str:
    """The same iteration over the table of edges, further than the query goes."""
    out = f", s0 AS (SELECT plant_id, i, j, k, ((plant_id * {SIDE} + i) * {SIDE} + j) * {SIDE} + k AS n, lod AS b, lod AS x, 0.0::DOUBLE AS p FROM lod)"
    for n, (old, new) in enumerate(steps):
        flow = f"SELECT e.n, sum(w * y.x) AS g, sum(w) AS d FROM ed e JOIN s{n} y ON y.n = e.m GROUP BY e.n"
        out += f", s{n + 1} AS MATERIALIZED (SELECT plant_id, i, j, k, n, b, x + step AS x, step AS p FROM (SELECT s.*, {old!r} * p + {new!r} * (b - x - coalesce(d * x - g, 0.0)) AS step FROM s{n} s LEFT JOIN ({flow}) f USING (n)))"
    return out


@query(("pixels", "frames", "grids"), f"{_LOD}, {_EDGES}{_solved(volume._steps(1.0, 1e-11))} SELECT plant_id, i, j, k, {q('b', 3)} AS lod, {q('x', 3)} AS smoothed FROM s{len(volume._steps(1.0, 1e-11))}")
def v5_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Every voxel's log-odds, smoothed with lam = 1."""
    out = volume.smooth(components.cut(volume.log_odds(counts(spark, d))), 10.0, 1.0)
    return out.select("plant_id", "i", "j", "k", r("lod", 3).alias("lod"), r("smoothed", 3).alias("smoothed"))


_CROSSED = f"""{_LOD}, ce AS (SELECT a.plant_id, a.i, a.j, a.k, a.i + p AS i2, a.j + q AS j2, a.k + s AS k2, a.lod AS v1 FROM lod a, (VALUES (1,0,0),(0,1,0),(0,0,1),(1,1,0),(1,0,1),(0,1,1),(1,1,1)) o(p, q, s)),
cx AS (SELECT c.*, b.lod AS v2 FROM ce c JOIN lod b ON b.plant_id = c.plant_id AND b.i = c.i2 AND b.j = c.j2 AND b.k = c.k2 WHERE (v1 > -15) <> (b.lod > -15))"""
_AT = lambda o, a: q(f"{o} + ({a} + (-15 - v1) / (v2 - v1) * ({a}2 - {a}) + 0.5) * voxel_size")


@query(("pixels", "frames", "grids"), f"{_CROSSED} SELECT plant_id, i, j, k, i2, j2, k2, {_AT('ox', 'i')} AS x, {_AT('oy', 'j')} AS y, {_AT('oz', 'k')} AS z FROM cx JOIN grids USING (plant_id)")
def v6_isosurface(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of the surface, each on an edge between two voxels."""
    vertices, _ = volume.isosurface(volume.log_odds(counts(spark, d)), load(spark, d, "grids"), -15.0)
    return vertices.select("plant_id", *(F.col(f"a.{a}").alias(a) for a in "ijk"), *(F.col(f"b.{a}").alias(f"{a}2") for a in "ijk"), *(r(c).alias(c) for c in "xyz"))


# The voxels of a tetrahedron are those on a way along the axes in some order; k of its four corners above give 1, 2, 1 triangles.
_STEP = lambda corner: (corner & 1) * SIDE * SIDE + (corner >> 1 & 1) * SIDE + (corner >> 2 & 1)
_WAYS = ", ".join(f"({_STEP(a)}, {_STEP(b)})" for _, a, b, _ in volume.TETRAHEDRA)


@query(("pixels", "frames", "grids"), f"""{_LOD}, up AS MATERIALIZED (SELECT plant_id, i, j, k, ((plant_id * {SIDE} + i) * {SIDE} + j) * {SIDE} + k AS n, CASE WHEN lod > -15 THEN 1 ELSE 0 END AS u FROM lod),
  te AS MATERIALIZED (SELECT plant_id, i, j, k, u, n + a AS n1, n + b AS n2, n + {_STEP(7)} AS n3 FROM up, (VALUES {_WAYS}) w(a, b) WHERE i < {SIDE - 1} AND j < {SIDE - 1} AND k < {SIDE - 1}),
  tn AS (SELECT t.*, t.u + x.u + y.u + z.u AS m FROM te t JOIN up x ON x.n = n1 JOIN up y ON y.n = n2 JOIN up z ON z.n = n3)
  SELECT plant_id, i, j, k, sum(CASE m WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS triangles FROM tn WHERE m BETWEEN 1 AND 3 GROUP BY ALL""")
def v6_triangles(spark: SparkSession, d: str) -> DataFrame:
    """The number of triangles of every cube that the surface crosses."""
    _, triangles = volume.isosurface(volume.log_odds(counts(spark, d)), load(spark, d, "grids"), -15.0)
    return triangles.groupBy("plant_id", "i", "j", "k").agg(F.count(F.lit(1)).alias("triangles"))


# --- the voxel graph


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_ids(load(spark, d, "occupied"))


_NODES = "WITH nd AS MATERIALIZED (SELECT plant_id, i, j, k, row_number() OVER (PARTITION BY plant_id ORDER BY k, j, i) AS node_id FROM occupied)"
_ADJ = f"""{_NODES}, adj AS MATERIALIZED (SELECT a.plant_id, a.node_id AS u, b.node_id AS v, sqrt((p*p + q*q + s*s)::DOUBLE) AS d FROM nd a, (SELECT unnest([-1, 0, 1]) AS p) x, (SELECT unnest([-1, 0, 1]) AS q) y, (SELECT unnest([-1, 0, 1]) AS s) z, nd b
  WHERE (p, q, s) <> (0, 0, 0) AND a.plant_id = b.plant_id AND b.i = a.i + p AND b.j = a.j + q AND b.k = a.k + s)"""
_OFF = "off AS MATERIALIZED (SELECT p, q, s, p*p + q*q + s*s AS d2 FROM (SELECT unnest(range(-4, 5)) AS p) x, (SELECT unnest(range(-4, 5)) AS q) y, (SELECT unnest(range(-4, 5)) AS s) z)"
_DT = f"""{_ADJ}, {_OFF},
near AS (SELECT plant_id, node_id, i + p AS bi, j + q AS bj, k + s AS bk, d2 FROM nd, off WHERE i + p BETWEEN 0 AND {SIDE - 1} AND j + q BETWEEN 0 AND {SIDE - 1} AND k + s BETWEEN 0 AND {SIDE - 1}),
dt AS MATERIALIZED (SELECT nd.*, dt FROM nd LEFT JOIN (SELECT plant_id, node_id, sqrt(min(d2)::DOUBLE) AS dt FROM near ANTI JOIN nd m ON m.plant_id = near.plant_id AND m.i = bi AND m.j = bj AND m.k = bk GROUP BY ALL) USING (plant_id, node_id))"""
_MB = f"""{_DT}, mb AS MATERIALIZED (SELECT * FROM dt ANTI JOIN (SELECT a.plant_id, a.u AS node_id FROM adj a JOIN dt x ON x.plant_id = a.plant_id AND x.node_id = a.u JOIN dt y ON y.plant_id = a.plant_id AND y.node_id = a.v WHERE y.dt >= x.dt + a.d - 1e-9) USING (plant_id, node_id)),
ball AS (SELECT plant_id, i + p AS i, j + q AS j, k + s AS k, max(dt) AS radius FROM mb, off WHERE d2 <= (dt + 0.5) * (dt + 0.5) GROUP BY ALL),
rad AS MATERIALIZED (SELECT n.plant_id, n.node_id, n.dt, radius FROM dt n JOIN ball USING (plant_id, i, j, k)),
gam AS MATERIALIZED (SELECT plant_id, node_id, 0.01 + 0.99 * pow(CASE WHEN radius = 1 THEN 1.0 ELSE (dt - 1) / (radius - 1) END, 2) AS gamma FROM rad)"""


@query(("occupied",), f"{_NODES} SELECT * FROM nd")
def w1_node_ids(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d)


@query(("occupied",), f"{_ADJ} SELECT plant_id, u, v, {q('d')} AS d FROM adj WHERE u < v")
def j6_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(nodes(spark, d)).select("plant_id", "u", "v", r("d").alias("d"))


def transformed(spark: SparkSession, d: str) -> DataFrame:
    return components.cut(graph.distance_transform(nodes(spark, d), DIMS))


@query(("occupied",), f"{_DT} SELECT plant_id, node_id, {q('dt')} AS dt FROM dt")
def g1_distance_transform(spark: SparkSession, d: str) -> DataFrame:
    return graph.distance_transform(nodes(spark, d), DIMS).select("plant_id", "node_id", r("dt").alias("dt"))


@query(("occupied",), f"{_NODES} SELECT DISTINCT n.plant_id, n.node_id FROM nd n, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(p, q, s) WHERE n.i + p BETWEEN 0 AND {SIDE - 1} AND n.j + q BETWEEN 0 AND {SIDE - 1} AND n.k + s BETWEEN 0 AND {SIDE - 1} AND NOT EXISTS (SELECT 1 FROM nd m WHERE m.plant_id = n.plant_id AND m.i = n.i + p AND m.j = n.j + q AND m.k = n.k + s)")
def g3_boundary(spark: SparkSession, d: str) -> DataFrame:
    return graph.boundary(nodes(spark, d), DIMS)


_FACES = "fc AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT plant_id, node_id, i, j, k, '{a}{s}' AS face FROM nd WHERE {a} = {0 if s == 0 else SIDE - 1}" for a in "ijk" for s in (0, 1)) + ")"
_TRUNC = f"""{_DT}, {_FACES},
fe AS MATERIALIZED (SELECT a.plant_id, a.face, a.node_id AS u, b.node_id AS v FROM fc a JOIN fc b ON a.plant_id = b.plant_id AND a.face = b.face AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
fr AS (SELECT plant_id, face, node_id, node_id AS origin FROM fc UNION SELECT fe.plant_id, fe.face, fe.v, origin FROM fr JOIN fe ON fe.plant_id = fr.plant_id AND fe.face = fr.face AND fe.u = fr.node_id),
fl AS (SELECT plant_id, face, node_id, min(origin) AS label FROM fr GROUP BY ALL),
fb AS MATERIALIZED (SELECT * FROM fl SEMI JOIN (SELECT plant_id, face, label FROM fl GROUP BY ALL HAVING count(*) >= 3) USING (plant_id, face, label))""".replace("WITH nd", "WITH RECURSIVE nd")


@query(("occupied",), f"{_TRUNC} SELECT plant_id, face, node_id FROM fb")
def g2_truncation(spark: SparkSession, d: str) -> DataFrame:
    return graph.truncation(nodes(spark, d), DIMS).select("plant_id", "face", "node_id")


@query(("occupied",), f"{_TRUNC} SELECT plant_id, face, node_id FROM fb JOIN dt USING (plant_id, node_id) WHERE face <> 'k0' QUALIFY row_number() OVER (PARTITION BY plant_id, face, label ORDER BY dt DESC, node_id) = 1")
def g16_truncated_tips(spark: SparkSession, d: str) -> DataFrame:
    return graph.truncated_tips(graph.truncation(nodes(spark, d), DIMS), transformed(spark, d))


@query(("occupied",), f"{_MB} SELECT plant_id, node_id, {q('dt')} AS dt FROM mb")
def g4_maximal_balls(spark: SparkSession, d: str) -> DataFrame:
    return graph.maximal_balls(transformed(spark, d)).select("plant_id", "node_id", r("dt").alias("dt"))


@query(("occupied",), f"{_MB} SELECT plant_id, node_id, {q('radius')} AS radius FROM rad")
def g5_local_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_radius(transformed(spark, d)).select("plant_id", "node_id", r("radius").alias("radius"))


@query(("occupied",), f"{_MB} SELECT plant_id, node_id, {q('gamma')} AS gamma FROM gam")
def g6_conductance(spark: SparkSession, d: str) -> DataFrame:
    dt = transformed(spark, d)
    return graph.conductance(dt, graph.local_radius(dt)).select("plant_id", "node_id", r("gamma").alias("gamma"))


@query(("occupied",), f"{_MB} SELECT a.plant_id, u, v, {q('d / ((x.gamma + y.gamma) / 2)')} AS w FROM adj a JOIN gam x ON x.plant_id = a.plant_id AND x.node_id = u JOIN gam y ON y.plant_id = a.plant_id AND y.node_id = v WHERE u < v")
def g7_travel_times(spark: SparkSession, d: str) -> DataFrame:
    dt = transformed(spark, d)
    return graph.travel_times(graph.edges(nodes(spark, d)), graph.conductance(dt, graph.local_radius(dt))).select("plant_id", "u", "v", r("w").alias("w"))


@query(("occupied",), f"{_MB.replace('0.01 + 0.99', '0.05 + 0.95').replace('END, 2)', 'END, 3)')} SELECT a.plant_id, u, v, {q('d / ((x.gamma + y.gamma) / 2)')} AS w FROM adj a JOIN gam x ON x.plant_id = a.plant_id AND x.node_id = u JOIN gam y ON y.plant_id = a.plant_id AND y.node_id = v WHERE u < v")
def g8_reweighted(spark: SparkSession, d: str) -> DataFrame:
    """Other conductance parameters on the stored radii and edges; the graph is not built again."""
    dt = transformed(spark, d)
    e, radius = components.cut(graph.edges(nodes(spark, d))), components.cut(graph.local_radius(dt))
    return graph.reweighted(e, dt, radius, 3.0, 0.05).select("plant_id", "u", "v", r("w").alias("w"))


_ROOT = "rt AS (SELECT plant_id, node_id FROM dt QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY k, dt DESC, node_id) = 1)"


@query(("occupied",), f"{_DT}, {_ROOT} SELECT * FROM rt")
def g15_root(spark: SparkSession, d: str) -> DataFrame:
    return graph.root(transformed(spark, d))


SMALL = 1024  # node ids of a block, so that ways cross several
# Distances by relaxation in SQL: as many rounds as any path needs here.
_ROUNDS = 80
_RELAX = "".join(f", b{n + 1} AS MATERIALIZED (SELECT plant_id, node_id, min(x) AS x FROM (SELECT plant_id, node_id, x FROM b{n} UNION ALL SELECT a.plant_id, a.v, x + a.d FROM b{n} b JOIN adj a ON a.plant_id = b.plant_id AND a.u = b.node_id) GROUP BY ALL)" for n in range(_ROUNDS))


def rooted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dt = transformed(spark, d)
    e = components.cut(graph.edges(nodes(spark, d)))
    return e, graph.shortest_paths(e, graph.root(dt), block=SMALL)


@query(("occupied",), f"{_DT}, {_ROOT}, b0 AS (SELECT plant_id, node_id, 0.0::DOUBLE AS x FROM rt){_RELAX} SELECT plant_id, node_id, {q('x')} AS dist FROM b{_ROUNDS}")
def g9_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return rooted(spark, d)[1].select("plant_id", "node_id", r("dist").alias("dist"))


@query(("occupied",), f"{_DT}, {_ROOT}, b0 AS (SELECT plant_id, node_id, 0.0::DOUBLE AS x FROM rt){_RELAX} SELECT plant_id, node_id, {q('x')} AS dist FROM b{_ROUNDS} WHERE x <= 6")
def g11_bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    e = components.cut(graph.edges(nodes(spark, d)))
    return graph.shortest_paths(e, graph.root(transformed(spark, d)), max_dist=6.0).select("plant_id", "node_id", r("dist").alias("dist"))


@query(("occupied",), f"{_DT}, {_ROOT}, b0 AS (SELECT plant_id, node_id, 0.0::DOUBLE AS x FROM rt){_RELAX}, goal AS (SELECT plant_id, x AS far FROM b{_ROUNDS} QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY (node_id * 7919) % 1009, node_id) = 1) SELECT plant_id, node_id, {q('x')} AS dist FROM b{_ROUNDS} JOIN goal USING (plant_id) WHERE x <= far")
def g11_target_paths(spark: SparkSession, d: str) -> DataFrame:
    """The search that ends at one target a plant: what is at most as far."""
    e, sp = rooted(spark, d)
    best = sp.groupBy("plant_id").agg(F.min(F.struct((F.col("node_id") * 7919 % 1009).alias("h"), "node_id")).alias("b"))
    goal = best.select("plant_id", F.col("b.node_id").alias("node_id"))
    return graph.shortest_paths(e, graph.root(transformed(spark, d)), targets=goal).select("plant_id", "node_id", r("dist").alias("dist"))


_SOURCES = "sr AS MATERIALIZED (SELECT plant_id, node_id FROM nd WHERE (node_id * 31) % 211 < 2)"
_SPREAD = "".join(f", c{n + 1} AS MATERIALIZED (SELECT plant_id, node_id, min_by(src, x * 1000000.0 + src) AS src, min(x) AS x FROM (SELECT * FROM c{n} UNION ALL SELECT a.plant_id, a.v, src, x + round(a.d * a.d) FROM c{n} c JOIN adj a ON a.plant_id = c.plant_id AND a.u = c.node_id) GROUP BY ALL)" for n in range(_ROUNDS))


@query(("occupied",), f"{_ADJ}, {_SOURCES}, c0 AS (SELECT plant_id, node_id, node_id AS src, 0.0::DOUBLE AS x FROM sr){_SPREAD} SELECT plant_id, node_id, x AS dist, src AS nearest_source FROM c{_ROUNDS}")
def g10_nearest_source(spark: SparkSession, d: str) -> DataFrame:
    """Many sources at once, over squared lengths, which add up exactly: of equally near sources the smaller one."""
    n = components.cut(nodes(spark, d))
    e = graph.edges(n).withColumn("q", F.round(F.col("d") * F.col("d")))
    return graph.shortest_paths(e, n.where("(node_id * 31) % 211 < 2"), "q", block=SMALL).select("plant_id", "node_id", "dist", "nearest_source")


@query(("occupied",), f"{_DT}, {_ROOT}, b0 AS (SELECT plant_id, node_id, 0.0::DOUBLE AS x FROM rt){_RELAX} SELECT plant_id, node_id AS tip, {q('x')} AS dist, {q('x')} AS walked FROM b{_ROUNDS}")
def g12_extract_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from every node that the root reaches: its steps sum to the distance."""
    e, sp = rooted(spark, d)
    steps = graph.extract_paths(sp, sp).join(sp, ["plant_id", "node_id"])
    walk = steps.join(graph.both_ways(e).withColumnsRenamed({"u": "node_id", "v": "prev"}), ["plant_id", "node_id", "prev"], "left")
    return walk.groupBy("plant_id", "tip").agg(r(F.max("dist")).alias("dist"), r(F.coalesce(F.sum("d"), F.lit(0.0))).alias("walked"))


_FIELD = f"{_DT}, fd AS MATERIALIZED (SELECT plant_id, node_id, dt * 10 + (node_id * 7919) % 101 / 10.0 AS u FROM dt)"
_UP = f"{_FIELD}, up AS MATERIALIZED (SELECT x.plant_id, x.node_id, coalesce((SELECT y.node_id FROM adj a JOIN fd y ON y.plant_id = a.plant_id AND y.node_id = a.v WHERE a.plant_id = x.plant_id AND a.u = x.node_id AND (y.u > x.u OR (y.u = x.u AND y.node_id < x.node_id)) ORDER BY y.u DESC, y.node_id LIMIT 1), x.node_id) AS nxt FROM fd x)"
_BASIN = f"{_UP}".replace("WITH nd", "WITH RECURSIVE nd") + ", climb AS (SELECT plant_id, node_id, nxt AS at FROM up UNION SELECT c.plant_id, c.node_id, u.nxt FROM climb c JOIN up u ON u.plant_id = c.plant_id AND u.node_id = c.at), bs AS MATERIALIZED (SELECT c.plant_id, c.node_id, c.at AS peak FROM climb c JOIN up u ON u.plant_id = c.plant_id AND u.node_id = c.at AND u.nxt = c.at)"


def field(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = F.col("dt") * 10 + (F.col("node_id") * 7919) % 101 / 10.0
    return transformed(spark, d).select("plant_id", "node_id", u.alias("u")), components.cut(graph.edges(nodes(spark, d)))


@query(("occupied",), f"{_UP} SELECT plant_id, node_id FROM up WHERE nxt = node_id")
def m1_local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_maxima(*field(spark, d))


# The sweep by brute force: what each node reaches through nodes swept before it.
_SWEEP = f"""{_FIELD}, rk AS MATERIALIZED (SELECT plant_id, node_id, u, row_number() OVER (PARTITION BY plant_id ORDER BY u DESC, node_id) AS o FROM fd),
ae AS MATERIALIZED (SELECT a.plant_id, x.o AS ou, y.o AS ov FROM adj a JOIN rk x ON x.plant_id = a.plant_id AND x.node_id = a.u JOIN rk y ON y.plant_id = a.plant_id AND y.node_id = a.v),
reach AS (SELECT plant_id, o AS v, o AS w FROM rk UNION SELECT r.plant_id, r.v, e.ov FROM reach r JOIN ae e ON e.plant_id = r.plant_id AND e.ou = r.w WHERE e.ov < r.v),
met AS MATERIALIZED (SELECT * FROM reach),
lab AS MATERIALIZED (SELECT plant_id, v, min(w) AS top FROM met GROUP BY ALL),
tops AS (SELECT plant_id, v AS peak FROM lab WHERE v = top),
ends AS (SELECT t.plant_id, t.peak, min(m.v) AS at FROM tops t JOIN met m ON m.plant_id = t.plant_id AND m.w = t.peak JOIN lab l ON l.plant_id = m.plant_id AND l.v = m.v AND l.top <> t.peak GROUP BY ALL),
tree AS MATERIALIZED (SELECT t.plant_id, p.node_id AS peak, p.u, s.node_id AS saddle_node, s.u AS saddle_val, r.node_id AS parent, coalesce(p.u - s.u, 'infinity'::DOUBLE) AS prominence
  FROM tops t JOIN rk p ON p.plant_id = t.plant_id AND p.o = t.peak LEFT JOIN ends e ON e.plant_id = t.plant_id AND e.peak = t.peak LEFT JOIN rk s ON s.plant_id = t.plant_id AND s.o = e.at
  LEFT JOIN lab l ON l.plant_id = t.plant_id AND l.v = e.at LEFT JOIN rk r ON r.plant_id = t.plant_id AND r.o = l.top)""".replace("WITH nd", "WITH RECURSIVE nd")


@query(("occupied",), f"{_SWEEP} SELECT l.plant_id, x.node_id, y.node_id AS peak FROM lab l JOIN rk x ON x.plant_id = l.plant_id AND x.o = l.v JOIN rk y ON y.plant_id = l.plant_id AND y.o = l.top")
def m2_basins(spark: SparkSession, d: str) -> DataFrame:
    return graph.basins(*field(spark, d))


@query(("occupied",), f"{_SWEEP} SELECT plant_id, peak, {q('u')} AS u, saddle_node, {q('saddle_val')} AS saddle_val, parent, {q('prominence')} AS prominence FROM tree")
def m3_saddles(spark: SparkSession, d: str) -> DataFrame:
    return graph.prominences(*field(spark, d)).select("plant_id", "peak", r("u").alias("u"), "saddle_node", r("saddle_val").alias("saddle_val"), "parent", r("prominence").alias("prominence"))


@query(("occupied",), f"{_SWEEP} SELECT l.plant_id, x.node_id, t.peak, t.saddle_node, t.parent FROM lab l JOIN rk x ON x.plant_id = l.plant_id AND x.o = l.v JOIN rk y ON y.plant_id = l.plant_id AND y.o = l.top JOIN tree t ON t.plant_id = l.plant_id AND t.peak = y.node_id")
def m4_join_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its peak, and where that peak ends."""
    peaks, labels = graph.join_tree(*field(spark, d))
    return labels.join(peaks, ["plant_id", "peak"]).select("plant_id", "node_id", "peak", "saddle_node", "parent")


@query(("occupied",), f"{_SWEEP} SELECT plant_id, peak, {q('u')} AS u, {q('prominence')} AS prominence, row_number() OVER (PARTITION BY plant_id ORDER BY prominence DESC, peak) AS rank FROM tree WHERE prominence >= 5")
def t1_prominent_maxima(spark: SparkSession, d: str) -> DataFrame:
    return graph.prominent_maxima(graph.prominences(*field(spark, d)), 5.0).select("plant_id", "peak", r("u").alias("u"), r("prominence").alias("prominence"), "rank")


@query(("occupied",), f"{_BASIN.replace('dt * 10 + (node_id * 7919) % 101 / 10.0 AS u', 'dt AS u')} SELECT plant_id, node_id, peak AS centre FROM bs")
def g14_snap_to_centre(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.snap_to_centre(transformed(spark, d), components.cut(graph.edges(n)), n.select("plant_id", "node_id"))


# --- curves

SIGMA = 2.0


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "curve_points")


_ARC = "WITH st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0.0) AS dd FROM curve_points WINDOW w AS (PARTITION BY curve_id ORDER BY seq)), arc AS MATERIALIZED (SELECT curve_id, seq, x, y, z, sum(dd) OVER (PARTITION BY curve_id ORDER BY seq) AS t FROM st)"
_ENDS = f"{_ARC}, en AS (SELECT *, first_value(seq) OVER w AS fs, first_value(t) OVER w AS ft, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz, last_value(seq) OVER w AS ls, last_value(t) OVER w AS lt, last_value(x) OVER w AS lx, last_value(y) OVER w AS ly, last_value(z) OVER w AS lz FROM arc WINDOW w AS (PARTITION BY curve_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), pad AS MATERIALIZED (SELECT curve_id, t, x, y, z FROM arc UNION ALL SELECT curve_id, 2*ft - t, 2*fx - x, 2*fy - y, 2*fz - z FROM en WHERE abs(t - ft) <= 12 AND seq <> fs UNION ALL SELECT curve_id, 2*lt - t, 2*lx - x, 2*ly - y, 2*lz - z FROM en WHERE abs(t - lt) <= 12 AND seq <> ls)"
_UNIFORM = "un AS (SELECT curve_id, n, unnest(range(1, n + 1)) AS seq, len FROM (SELECT curve_id, max(t) AS len, greatest(2, ceil(max(t) / 5.0)::BIGINT + 1) AS n FROM arc GROUP BY curve_id)), qs AS MATERIALIZED (SELECT curve_id, seq, len * (seq - 1) / (n - 1) AS t FROM un)"
_LOOK = "SELECT curve_id, seq, {x}, {y}, {z} FROM (SELECT q.curve_id, q.seq, q.t, lo.t AS t0, lo.x AS x0, lo.y AS y0, lo.z AS z0, hi.t AS t1, hi.x AS x1, hi.y AS y1, hi.z AS z1 FROM qs q ASOF JOIN arc lo ON q.curve_id = lo.curve_id AND q.t >= lo.t ASOF LEFT JOIN arc hi ON q.curve_id = hi.curve_id AND q.t <= hi.t)"


@query(("curve_points",), f"{_ARC} SELECT curve_id, seq, {q('t')} AS t FROM arc")
def w2_arc_length(spark: SparkSession, d: str) -> DataFrame:
    return curves.arc_length(points(spark, d)).select("curve_id", "seq", r("t").alias("t"))


@query(("curve_points",), f"{_ENDS} SELECT curve_id, {q('t', 3)} AS t, {q('x', 3)} AS x, {q('y', 3)} AS y, {q('z', 3)} AS z FROM pad")
def w8_padded(spark: SparkSession, d: str) -> DataFrame:
    return curves.padded(curves.arc_length(points(spark, d)), 12.0).select("curve_id", *(r(c, 3).alias(c) for c in "txyz"))


def queries_at(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    profile = components.cut(curves.arc_length(points(spark, d)))
    return profile, curves.uniform_samples(profile.groupBy("curve_id").agg(F.max("t").alias("length")), 5.0)


@query(("curve_points",), f"{_ARC}, {_UNIFORM} SELECT curve_id, seq, {q('t')} AS t FROM qs")
def k5_uniform_samples(spark: SparkSession, d: str) -> DataFrame:
    return queries_at(spark, d)[1].select("curve_id", "seq", r("t").alias("t"))


def _smoothed(name: str, source: str, key: str = "seq") -> str:
    """CTEs that end in `name`: the rows of source(curve_id, key, t) with x, y, z and dx, dy, dz of the curve of width 2."""
    k = ", ".join(f"q.{c.strip()}" for c in key.split(","))
    return f"""{name}_in AS MATERIALIZED (SELECT q.curve_id, {k}, q.t, p.t AS pt, p.x, p.y, p.z, 0.0::DOUBLE AS near FROM {source} q JOIN pad p ON q.curve_id = p.curve_id AND abs(p.t - q.t) <= 12),
{name}_two AS (SELECT q.curve_id, {k}, q.t, lo.t AS t0, lo.x AS x0, lo.y AS y0, lo.z AS z0, hi.t AS t1, hi.x AS x1, hi.y AS y1, hi.z AS z1, least(abs(lo.t - q.t), abs(hi.t - q.t)) AS near FROM (SELECT * FROM {source} ANTI JOIN {name}_in USING (curve_id, {key})) q ASOF JOIN pad lo ON q.curve_id = lo.curve_id AND q.t >= lo.t ASOF JOIN pad hi ON q.curve_id = hi.curve_id AND q.t < hi.t),
{name}_all AS (SELECT * FROM {name}_in UNION ALL SELECT curve_id, {key}, t, t0, x0, y0, z0, near FROM {name}_two UNION ALL SELECT curve_id, {key}, t, t1, x1, y1, z1, near FROM {name}_two),
{name}_w AS (SELECT *, exp(-(pow((pt - t) / 2.0, 2) - pow(near / 2.0, 2)) / 2) AS w, (pt - t) / 4.0 AS e FROM {name}_all),
{name}_s AS (SELECT curve_id, {key}, t, sum(w) AS s0, sum(w*e) AS d0, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*z) AS sz, sum(w*e*x) AS ex, sum(w*e*y) AS ey, sum(w*e*z) AS ez FROM {name}_w GROUP BY ALL),
{name} AS MATERIALIZED (SELECT curve_id, {key}, t, sx/s0 AS x, sy/s0 AS y, sz/s0 AS z, (ex - sx/s0*d0)/s0 AS dx, (ey - sy/s0*d0)/s0 AS dy, (ez - sz/s0*d0)/s0 AS dz FROM {name}_s)"""


_UNIT = lambda n, digits=3: ", ".join(f"CASE WHEN n > 1e-9 THEN {q(f'{c}/n', digits)} ELSE 'nan'::DOUBLE END AS {c}" for c in n.split())


@query(("curve_points",), f"{_ENDS}, {_UNIFORM}, {_smoothed('kp', 'qs')} SELECT curve_id, seq, {q('x', 3)} AS x, {q('y', 3)} AS y, {q('z', 3)} AS z FROM kp")
def k1_smoothed_positions(spark: SparkSession, d: str) -> DataFrame:
    profile, at = queries_at(spark, d)
    return curves.kernel_positions(at, profile, SIGMA).select("curve_id", "seq", *(r(c, 3).alias(c) for c in "xyz"))


@query(("curve_points",), f"{_ENDS}, {_UNIFORM}, {_smoothed('kp', 'qs')} SELECT curve_id, seq, {_UNIT('dx dy dz')} FROM (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS n FROM kp)")
def k4_tangents(spark: SparkSession, d: str) -> DataFrame:
    profile, at = queries_at(spark, d)
    return curves.kernel_tangents(at, profile, SIGMA).select("curve_id", "seq", *(r(c, 3).alias(c) for c in ("dx", "dy", "dz")))


_DENSE = f"""{_ENDS}, dn AS (SELECT curve_id, max(t) AS len, greatest(100, ceil(max(t) / 0.5)::BIGINT + 1) AS n FROM arc GROUP BY 1 HAVING count(*) > 1), dq AS MATERIALIZED (SELECT curve_id, seq, len * (seq - 1) / (n - 1) AS t FROM (SELECT curve_id, len, n, unnest(range(1, n + 1)) AS seq FROM dn)),
{_smoothed('dk', 'dq')}, ds AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0.0) AS step FROM dk WINDOW w AS (PARTITION BY curve_id ORDER BY seq)), dense AS MATERIALIZED (SELECT curve_id, seq, t, x, y, z, sum(step) OVER (PARTITION BY curve_id ORDER BY seq) AS s FROM ds),
ln AS MATERIALIZED (SELECT curve_id, max(s) AS len FROM dense GROUP BY 1), sl AS MATERIALIZED (SELECT curve_id, s, min(t) AS t0, max(t) AS t1 FROM dense GROUP BY ALL)"""


def _s_to_t(name: str, source: str, keys: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT q.curve_id, {', '.join('q.' + k for k in keys.split())}, CASE WHEN hi.s > lo.s THEN lo.t1 + (q.s - lo.s) / (hi.s - lo.s) * (hi.t0 - lo.t1) ELSE lo.t1 END AS t FROM {source} q ASOF JOIN sl lo ON q.curve_id = lo.curve_id AND q.s >= lo.s ASOF LEFT JOIN sl hi ON q.curve_id = hi.curve_id AND q.s < hi.s)"


def dense_curves(spark: SparkSession, d: str, table: str = "calm_points") -> tuple[DataFrame, DataFrame]:
    """Points and dense smoothed curves. The calm points have no gap wider than the kernel, over which rounding decides."""
    p = components.cut(load(spark, d, table))
    return p, components.cut(curves.smooth_curves(p, SIGMA))


@query(("curve_points",), f"{_DENSE} SELECT curve_id, seq, {q('t', 3)} AS t, {q('s', 3)} AS s, {q('x', 3)} AS x, {q('y', 3)} AS y, {q('z', 3)} AS z FROM dense")
def k2_dense_curves(spark: SparkSession, d: str) -> DataFrame:
    return curves.smooth_curves(points(spark, d), SIGMA).select("curve_id", "seq", *(r(c, 3).alias(c) for c in ("t", "s", "x", "y", "z")))


_STEPS = "us AS MATERIALIZED (SELECT curve_id, seq, n, len * (seq - 1) / (n - 1) AS s FROM (SELECT curve_id, len, n, unnest(range(1, n + 1)) AS seq FROM (SELECT curve_id, len, greatest(2, ceil(len / 1.5)::BIGINT + 1) AS n FROM ln)))"


def _calm(sql: str) -> str:
    return sql.replace("FROM curve_points", "FROM calm_points")


@query(("calm_points",), _calm(f"{_DENSE}, {_STEPS}, {_s_to_t('ut', 'us', 'seq n s')}, {_smoothed('uk', 'ut', 'seq, n, s')} SELECT u.curve_id, u.seq, {q('u.s', 3)} AS s, " + ", ".join(f"{q(f'CASE WHEN u.seq = 1 THEN f{c} WHEN u.seq = n THEN l{c} ELSE u.{c} END', 3)} AS {c}" for c in "xyz") + f", {_UNIT('dx dy dz')} FROM (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS nn FROM uk) u JOIN (SELECT DISTINCT curve_id, fx, fy, fz, lx, ly, lz FROM en) USING (curve_id)".replace("WHEN n > 1e-9", "WHEN nn > 1e-9").replace("/n", "/nn")))
def k5_sampled_curves(spark: SparkSession, d: str) -> DataFrame:
    """Positions and unit tangents at equal steps of arc length, the ends pinned."""
    p, dense = dense_curves(spark, d)
    return curves.sample_uniform(dense, p, SIGMA, 1.5).select("curve_id", "seq", *(r(c, 3).alias(c) for c in ("s", "x", "y", "z", "dx", "dy", "dz")))


# Targets beside every smoothed sample; the foot by bisection around the nearest dense point.
_TARGETS = f"{_DENSE}, {_STEPS}, {_s_to_t('ut', 'us', 'seq')}, {_smoothed('uk', 'ut')}, tg AS MATERIALIZED (SELECT curve_id, seq AS target_id, x + 0.05 AS qx, y - 0.03 AS qy, z + 0.02 AS qz FROM uk), nr AS MATERIALIZED (SELECT g.*, d.seq, d.t AS td, row_number() OVER (PARTITION BY curve_id, target_id ORDER BY pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2), d.seq) AS k FROM tg g JOIN dense d USING (curve_id))"
_NEAR = "b0 AS MATERIALIZED (SELECT curve_id, target_id, qx, qy, qz, CASE WHEN seq = 1 THEN 0.0 WHEN seq = n THEN len ELSE greatest(0.0, td - len / (n - 1)) END AS lo, CASE WHEN seq = 1 THEN 0.0 WHEN seq = n THEN len ELSE least(len, td + len / (n - 1)) END AS hi FROM nr JOIN dn USING (curve_id) WHERE k = 1)"


def _halved(rounds: int) -> str:
    out = ""
    for k in range(rounds):
        out += f", m{k} AS MATERIALIZED (SELECT *, (lo + hi) / 2 AS t FROM b{k}), {_smoothed(f'h{k}', f'm{k}', 'target_id, qx, qy, qz, lo, hi')}, b{k + 1} AS MATERIALIZED (SELECT curve_id, target_id, qx, qy, qz, CASE WHEN f < 0 THEN t ELSE lo END AS lo, CASE WHEN f < 0 THEN hi ELSE t END AS hi FROM (SELECT *, (x - qx) * dx + (y - qy) * dy + (z - qz) * dz AS f FROM h{k}))"
    return out


@query(("calm_points",), _calm(f"{_TARGETS}, {_NEAR}{_halved(34)}, fin AS (SELECT curve_id, target_id, qx, qy, qz, (lo + hi) / 2 AS t FROM b34), {_smoothed('ff', 'fin', 'target_id, qx, qy, qz')} SELECT curve_id, target_id, {q('t', 3)} AS t, {q('sqrt(pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2))', 3)} AS dist FROM ff"))
def k6_projected_points(spark: SparkSession, d: str) -> DataFrame:
    """Points beside smoothed curves without gaps wider than the kernel, projected back on them."""
    p, dense = dense_curves(spark, d)
    at = curves.sample_uniform(dense, p, SIGMA, 1.5).select("curve_id", F.col("seq").alias("target_id"), "s")
    near = curves.evaluate(at, dense, p, SIGMA).select("curve_id", "target_id", (F.col("x") + 0.05).alias("qx"), (F.col("y") - 0.03).alias("qy"), (F.col("z") + 0.02).alias("qz"))
    return curves.project_points(near, dense, p, SIGMA).select("curve_id", "target_id", r("t", 3).alias("t"), r("dist", 3).alias("dist"))


def _fitted(samples: str, keys: str) -> str:
    """CTEs over samples(keys, u, w, x, y, z) that end in `fit`: the coefficients of quadratics, nu and se, in closed form."""
    m = [[f"m{a + b}" for b in range(3)] for a in range(3)]
    cof = lambda a, b: f"({m[(a + 1) % 3][(b + 1) % 3]} * {m[(a + 2) % 3][(b + 2) % 3]} - {m[(a + 1) % 3][(b + 2) % 3]} * {m[(a + 2) % 3][(b + 1) % 3]})"
    sums = ", ".join([*(f"sum(w * pow(u, {k})) AS m{k}, sum(w * w * pow(u, {k})) AS q{k}" for k in range(5)), *(f"sum(w * pow(u, {k}) * {c}) AS p{k}{c}" for k in range(3) for c in "xyz")])
    det = " + ".join(f"{m[0][b]} * {cof(0, b)}" for b in range(3))
    inv = ", ".join(f"{cof(b, a)} / ({det}) AS i{a}{b}" for a in range(3) for b in range(3))
    coef = ", ".join(" + ".join(f"i{a}{k} * p{k}{c}" for k in range(3)) + f" AS b{a}{c}" for a in range(3) for c in "xyz")
    trace = " + ".join(f"i{a}{b} * q{a + b}" for a in range(3) for b in range(3))
    left = " + ".join(f"pow({c} - (b0{c} + b1{c} * u + b2{c} * u * u), 2)" for c in "xyz")
    return f"""mo AS MATERIALIZED (SELECT {keys}, {sums} FROM {samples} GROUP BY {keys}), iv AS (SELECT *, {inv} FROM mo), co AS MATERIALIZED (SELECT {keys}, {coef}, greatest(m0 - ({trace}), 1.0) AS nu, i11 FROM iv),
fit AS MATERIALIZED (SELECT *, sqrt(2.0) * sqrt(rss / (3 * nu) * i11) / sqrt(b1x*b1x + b1y*b1y + b1z*b1z) AS se FROM co JOIN (SELECT {keys}, sum(w * ({left})) AS rss FROM {samples} JOIN co USING ({keys}) GROUP BY {keys}) USING ({keys}))"""


_FITS = f"{_DENSE}, fa AS (SELECT curve_id, 1 AS fit_id, 0.25 * len AS c0 FROM ln UNION ALL SELECT curve_id, 2, 0.0 FROM ln UNION ALL SELECT curve_id, 3, len FROM ln), fw AS MATERIALIZED (SELECT f.*, greatest(0.0, c0 - 6.0) AS s_min, least(len, c0 + 6.0) AS s_max FROM fa f JOIN ln USING (curve_id)), fs AS MATERIALIZED (SELECT curve_id, fit_id, c0, k, s_min + (s_max - s_min) * k / 30.0 AS s FROM (SELECT *, unnest(range(0, 31)) AS k FROM fw WHERE s_max - s_min >= 0.2)), {_s_to_t('ft', 'fs', 'fit_id c0 k s')}, {_smoothed('fk', 'ft', 'fit_id, c0, k, s')}, sm AS MATERIALIZED (SELECT curve_id, fit_id, (s - c0) / 2.0 AS u, exp(-pow((s - c0) / 2.0, 2) / 2) AS w, x, y, z FROM fk), {_fitted('sm', 'curve_id, fit_id')}"


@query(("calm_points",), _calm(f"{_FITS} SELECT curve_id, fit_id, f.curve_id IS NULL AS degenerate, " + ", ".join(f"coalesce({q(f'b1{c} / sqrt(b1x*b1x + b1y*b1y + b1z*b1z)', 3)}, 'nan'::DOUBLE) AS t{c}" for c in "xyz") + f", coalesce({q('b2x', 3)}, 'nan'::DOUBLE) AS b2x, coalesce({q('nu', 3)}, 'nan'::DOUBLE) AS nu, coalesce({q('se', 3)}, 'nan'::DOUBLE) AS se FROM fw LEFT JOIN fit f USING (curve_id, fit_id)".replace("f.curve_id IS NULL", "f.nu IS NULL")))
def q1_tangent_fits(spark: SparkSession, d: str) -> DataFrame:
    """Three fits a curve: at a quarter of its length and at both ends."""
    p, dense = dense_curves(spark, d)
    ends = dense.groupBy("curve_id").agg(F.max("s").alias("l")).select("curve_id", F.posexplode(F.array(0.25 * F.col("l"), F.lit(0.0), F.col("l"))).alias("k", "s0"))
    out = measure.tangent_fit(ends.select("curve_id", (F.col("k") + 1).alias("fit_id"), "s0"), dense, p, SIGMA, 2.0)
    return out.select("curve_id", "fit_id", "degenerate", *(r(c, 3).alias(c) for c in ("tx", "ty", "tz", "b2x", "nu", "se")))


@query(("curve_points",), f"{_ARC}, {_UNIFORM} {_LOOK.format(x=q('CASE WHEN t1 > t0 THEN x0 + (t - t0) / (t1 - t0) * (x1 - x0) ELSE x0 END', 3) + ' AS x', y=q('CASE WHEN t1 > t0 THEN y0 + (t - t0) / (t1 - t0) * (y1 - y0) ELSE y0 END', 3) + ' AS y', z=q('CASE WHEN t1 > t0 THEN z0 + (t - t0) / (t1 - t0) * (z1 - z0) ELSE z0 END', 3) + ' AS z')}")
def k3_lookup(spark: SparkSession, d: str) -> DataFrame:
    profile, at = queries_at(spark, d)
    return curves.lookup(at, profile, "t", ["x", "y", "z"]).select("curve_id", "seq", *(r(c, 3).alias(c) for c in "xyz"))


@query(("curve_points",), f"{_ARC}, tg AS (SELECT curve_id, seq AS target_id, x + 1.0 AS qx, y AS qy, z + 0.2 AS qz FROM curve_points) SELECT curve_id, target_id, seq, {q('dist2')} AS dist2 FROM (SELECT g.curve_id, target_id, seq, pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2) AS dist2 FROM tg g JOIN arc a ON a.curve_id = g.curve_id) QUALIFY row_number() OVER (PARTITION BY curve_id, target_id ORDER BY dist2, seq) = 1")
def j8_nearest_points(spark: SparkSession, d: str) -> DataFrame:
    profile = curves.arc_length(points(spark, d))
    targets = points(spark, d).select("curve_id", F.col("seq").alias("target_id"), (F.col("x") + 1.0).alias("qx"), F.col("y").alias("qy"), (F.col("z") + 0.2).alias("qz"))
    return curves.nearest_points(targets, profile.withColumn("s", F.col("t"))).select("curve_id", "target_id", "seq", r("dist2").alias("dist2"))


# --- measurements


def fruits(spark: SparkSession, d: str) -> DataFrame:
    return measure.fruit_rank(load(spark, d, "fruits"))


_RANK = "WITH fr AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY arc, node_id) AS fruit_id FROM fruits)"
_TWO_PI = repr(2 * math.pi)
_TURN = f"{_RANK}, tn AS (SELECT *, azimuth - lag(azimuth) OVER w AS turn, arc - lag(arc) OVER w AS internode FROM fr WINDOW w AS (PARTITION BY plant_id ORDER BY fruit_id)), ch AS (SELECT plant_id, sum(CASE WHEN sin(turn) > 0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN sin(turn) < 0 THEN 1 ELSE 0 END) AS down FROM tn GROUP BY 1), wind AS (SELECT plant_id, CASE WHEN up > down THEN 'ccw' WHEN up < down THEN 'cw' ELSE 'ambiguous' END AS orientation FROM ch), dv AS (SELECT t.*, orientation, degrees(CASE WHEN orientation = 'cw' THEN -turn - floor(-turn / {_TWO_PI}) * {_TWO_PI} ELSE turn - floor(turn / {_TWO_PI}) * {_TWO_PI} END) AS div_angle FROM tn t JOIN wind USING (plant_id))"


@query(("fruits",), f"{_RANK} SELECT plant_id, node_id, fruit_id FROM fr")
def w6_fruit_rank(spark: SparkSession, d: str) -> DataFrame:
    return fruits(spark, d).select("plant_id", "node_id", "fruit_id")


@query(("fruits",), f"{_TURN} SELECT plant_id, fruit_id, internode FROM tn")
def w4_internodes(spark: SparkSession, d: str) -> DataFrame:
    return measure.internodes(fruits(spark, d)).select("plant_id", "fruit_id", "internode")


@query(("fruits",), f"{_TURN} SELECT plant_id, orientation FROM wind")
def a10_chirality(spark: SparkSession, d: str) -> DataFrame:
    return measure.chirality(fruits(spark, d))


@query(("fruits",), f"{_TURN} SELECT plant_id, fruit_id, orientation, {q('div_angle')} AS div_angle FROM dv")
def w5_divergence(spark: SparkSession, d: str) -> DataFrame:
    return measure.divergence(fruits(spark, d)).select("plant_id", "fruit_id", "orientation", r("div_angle").alias("div_angle"))


@query(("fruits",), f"{_TURN} SELECT plant_id, orientation, count(*) AS n_fruits, string_agg(arc::VARCHAR, ',' ORDER BY fruit_id) AS arcs, coalesce(string_agg(internode::VARCHAR, ',' ORDER BY fruit_id) FILTER (fruit_id > 1), '') AS internodes, {q('coalesce(sum(div_angle), 0)', 2)} AS turned FROM dv GROUP BY 1, 2")
def a11_roll_up(spark: SparkSession, d: str) -> DataFrame:
    out = measure.roll_up(measure.internodes(measure.divergence(fruits(spark, d))))
    return out.select("plant_id", "orientation", "n_fruits", F.array_join("arcs", ",").alias("arcs"), F.array_join("internodes", ",").alias("internodes"), r(F.aggregate("div_angles", F.lit(0.0), lambda a, x: a + x), 2).alias("turned"))


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Fruits with all columns of a measurement, those without a source derived from the node."""
    f = measure.internodes(measure.divergence(fruits(spark, d)))
    n = F.col("node_id")
    return f.withColumns({"length": n % 97 / 4.0, "polar": n % 31 / 10.0, "se_polar": n % 7 / 8.0, "se_azimuth": n % 5 / 4.0, "cov": n % 3 - 1.0, "flagged": n % 11 == 0, "azimuth": r("azimuth", 3), "div_angle": r("div_angle", 3)})


_MEASURED = f"{_TURN}, me AS (SELECT plant_id, fruit_id, orientation, node_id % 97 / 4.0 AS length, node_id % 31 / 10.0 AS polar, node_id % 7 / 8.0 AS se_polar, {q('azimuth', 3)} AS azimuth, node_id % 5 / 4.0 AS se_azimuth, node_id % 3 - 1.0::DOUBLE AS cov, node_id % 11 = 0 AS flagged, internode, {q('div_angle', 3)} AS div_angle FROM dv)"
_CSV = ", ".join(f"{f'CASE WHEN fruit_id = 1 THEN {c} END' if c in ('plant_id', 'orientation') else f'CASE WHEN fruit_id > 1 THEN {c} END' if c in ('internode', 'div_angle') else c} AS \"{name}\"" for name, c in results.CSV.items())


@query(("fruits",), f"{_MEASURED} SELECT plant_id AS key_plant, fruit_id AS key_fruit, {_CSV} FROM me")
def s11_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return results.export_rows(measured(spark, d))


@query(("fruits",), f"{_MEASURED} SELECT plant_id, orientation, string_agg(length::VARCHAR, ',' ORDER BY fruit_id) AS lengths, string_agg(flagged::VARCHAR, ',' ORDER BY fruit_id) AS flags, coalesce(string_agg(internode::VARCHAR, ',' ORDER BY fruit_id) FILTER (fruit_id > 1), '') AS internodes FROM me GROUP BY 1, 2")
def s12_json_export(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON text of each plant says."""
    text = results.json_rows(measured(spark, d))
    read = F.from_json("measurement", "orientation string, lengths array<string>, flagged array<string>, internodes array<string>")
    return text.select("plant_id", read.alias("m")).select("plant_id", "m.orientation", F.array_join("m.lengths", ",").alias("lengths"), F.array_join("m.flagged", ",").alias("flags"), F.array_join("m.internodes", ",").alias("internodes"))


@query(("images",), "SELECT plant_id, frame_idx, concat_ws(' ', frame_idx::VARCHAR || '_rgb.jpg', x::VARCHAR, y::VARCHAR, z::VARCHAR) AS value FROM images")
def s9_pose_lines(spark: SparkSession, d: str) -> DataFrame:
    return results.pose_lines(load(spark, d, "images").withColumn("img_name", F.concat("frame_idx", F.lit("_rgb.jpg"))))


@query((), "SELECT o_orderkey AS plant_id, o_custkey AS value, 'saved' AS found FROM orders")
def s10_loaded_results(spark: SparkSession, d: str) -> DataFrame:
    """Results saved and loaded; a place where nothing has been saved gives none."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("plant_id"), F.col("o_custkey").alias("value"))
    folder = components.new_folder(spark, "results")
    none = results.load_results(spark, f"{folder}/none", rows.schema)
    results.save_results(rows, none, f"{folder}/saved")
    return results.load_results(spark, f"{folder}/saved", rows.schema).withColumn("found", F.lit("saved")).unionByName(none.withColumn("found", F.lit("none")))


@query(("fruits",), f"{_TURN} SELECT plant_id, fruit_id, step, {q('azimuth + step / 4.0 * (CASE WHEN orientation = chr(99) || chr(119) THEN -((azimuth - nxt) - floor((azimuth - nxt) / ' + _TWO_PI + ') * ' + _TWO_PI + ') ELSE (nxt - azimuth) - floor((nxt - azimuth) / ' + _TWO_PI + ') * ' + _TWO_PI + ' END)')} AS angle FROM (SELECT *, lead(azimuth) OVER (PARTITION BY plant_id ORDER BY fruit_id) AS nxt FROM dv), (SELECT unnest(range(0, 5)) AS step) WHERE nxt IS NOT NULL")
def q11_divergence_arcs(spark: SparkSession, d: str) -> DataFrame:
    return measure.arc_samples(measure.divergence(fruits(spark, d)), 4).select("plant_id", "fruit_id", "step", r("angle").alias("angle"))


# Some branches run along the stem, some stems along the reference, either way.
_DIRS = """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS sx, embedding[2]::DOUBLE AS sy, embedding[3]::DOUBLE AS sz, embedding[4]::DOUBLE AS bx, embedding[5]::DOUBLE AS by_, embedding[6]::DOUBLE AS bz FROM embeddings),
e2 AS (SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE sx END AS sx, CASE WHEN vec_id % 10 IN (1, 2) THEN 0.0 ELSE sy END AS sy, CASE WHEN vec_id % 10 IN (1, 2) THEN 0.0 ELSE sz END AS sz, CASE WHEN vec_id % 10 = 0 THEN sx ELSE bx END AS bx, CASE WHEN vec_id % 10 = 0 THEN sy ELSE by_ END AS by_, CASE WHEN vec_id % 10 = 0 THEN sz ELSE bz END AS bz FROM e),
n AS (SELECT vec_id, sx / s AS sx, sy / s AS sy, sz / s AS sz, bx / b AS bx, by_ / b AS by_, bz / b AS bz FROM (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS s, sqrt(bx*bx+by_*by_+bz*bz) AS b FROM e2) WHERE s > 0 AND b > 0), g AS (SELECT *, greatest(-1.0, least(1.0, sx*bx+sy*by_+sz*bz)) AS c FROM n),
a AS (SELECT *, bx - sx * c AS px, bz * -sy + by_ * sz AS py, sqrt(pow(bx - c*sx, 2) + pow(by_ - c*sy, 2) + pow(bz - c*sz, 2)) < 1.4901161193847656e-8 OR abs(sx) > 1 - 1.4901161193847656e-8 AS flat FROM g),
"""
_ANGLES = f"{_DIRS} v AS (SELECT *, acos(c) AS theta, CASE WHEN flat THEN 'nan'::DOUBLE ELSE atan2(py, px) - floor(atan2(py, px) / {_TWO_PI}) * {_TWO_PI} END AS phi FROM a)"


def directions(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    out = e.select("vec_id", *(at(k).alias(n) for k, n in enumerate(("sx", "sy", "sz", "bx", "by", "bz"))))
    kind = F.col("vec_id") % 10
    out = out.withColumns({f"b{c}": F.when(kind == 0, F.col(f"s{c}")).otherwise(F.col(f"b{c}")) for c in "xyz"})
    out = out.withColumns({"sx": F.when(kind == 1, 1.0).when(kind == 2, -1.0).otherwise(F.col("sx")), **{f"s{c}": F.when(kind.isin(1, 2), 0.0).otherwise(F.col(f"s{c}")) for c in "yz"}})
    for p in "sb":
        n = F.sqrt(sum(F.col(f"{p}{c}") * F.col(f"{p}{c}") for c in "xyz"))
        out = out.withColumn("_n", n).where("_n > 0").withColumns({f"{p}{c}": F.col(f"{p}{c}") / F.col("_n") for c in "xyz"}).drop("_n")
    return out.withColumns({"rx": F.lit(1.0), "ry": F.lit(0.0), "rz": F.lit(0.0)})


@query((), f"{_ANGLES} SELECT vec_id, {q('theta')} AS theta, {q('phi')} AS phi FROM v")
def q4_polar_azimuth(spark: SparkSession, d: str) -> DataFrame:
    return measure.polar_azimuth(directions(spark, d)).select("vec_id", r("theta").alias("theta"), r("phi").alias("phi"))


# The gradient of the azimuth in the stem direction, from vectors: g = (X * (r x b) + Y * (c * r + (s . r) * b)) / (X^2 + Y^2), across s.
_ERRORS = f"""{_ANGLES}, gr AS (SELECT *, (py * (c + sx * bx)) / (px*px + py*py) AS gx, (px * -bz + py * sx * by_) / (px*px + py*py) AS gy, (px * by_ + py * sx * bz) / (px*px + py*py) AS gz FROM v),
tg AS (SELECT *, gx - k * sx AS hx, gy - k * sy AS hy, gz - k * sz AS hz FROM (SELECT *, gx*sx + gy*sy + gz*sz AS k FROM gr)),
er AS (SELECT *, sqrt((0.0004 + 0.0009) / 2) AS e_t, sqrt(0.0002 * (hx*hx + hy*hy + hz*hz) + 0.00045 / (1 - c*c)) AS e_p, -0.0002 * (hx * (bx - c*sx) + hy * (by_ - c*sy) + hz * (bz - c*sz)) / sqrt(1 - c*c) AS e_c FROM tg WHERE NOT flat)"""


@query((), f"{_ERRORS} SELECT v.vec_id, v.vec_id % 17 = 3 OR v.flat AS flagged, CASE WHEN v.vec_id % 17 = 3 THEN 'nan'::DOUBLE ELSE {q('v.theta')} END AS theta, CASE WHEN v.vec_id % 17 = 3 THEN 'nan'::DOUBLE WHEN v.flat THEN {q('degrees(0.02)')} ELSE {q('degrees(e_t)')} END AS se_polar, CASE WHEN v.vec_id % 17 = 3 OR v.flat THEN 'nan'::DOUBLE ELSE {q('degrees(e_p)', 3)} END AS se_azimuth, CASE WHEN v.vec_id % 17 = 3 OR v.flat THEN 'nan'::DOUBLE ELSE {q('degrees(degrees(e_c))', 3)} END AS cov FROM v LEFT JOIN er USING (vec_id)")
def q5_angle_errors(spark: SparkSession, d: str) -> DataFrame:
    """Angles with their errors and covariance; some fits are degenerate, some directions have no azimuth."""
    rows = directions(spark, d).withColumns({"se_s": F.lit(0.02), "se_b": F.lit(0.03), "degenerate": F.col("vec_id") % 17 == 3})
    out = measure.emergence_angles(rows)
    return out.select("vec_id", "flagged", r("theta").alias("theta"), r("se_polar").alias("se_polar"), r("se_azimuth", 3).alias("se_azimuth"), r("cov", 3).alias("cov"))


@query((), f"{_ANGLES} SELECT vec_id AS fruit_id, step, " + ", ".join(q(f"vec_id + 2.0 * (sin((1 - step / 7.0) * theta) * s{c} + sin(step / 7.0 * theta) * b{'y_' if c == 'y' else c}) / sin(theta)", 3) + f" AS {c}" for c in "xyz") + " FROM v, (SELECT unnest(range(0, 8)) AS step) WHERE theta > 1e-3")
def q11_polar_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The arc from each stem direction to its branch direction, about a junction."""
    rows = measure.polar_azimuth(directions(spark, d)).select(F.lit(0).alias("plant_id"), F.col("vec_id").alias("fruit_id"), "theta", *(f"{p}{c}" for p in "sb" for c in "xyz"), *(F.col("vec_id").cast("double").alias(f"p{c}") for c in "xyz"))
    return measure.polar_arcs(rows, 4.0, 8).select("fruit_id", "step", *(r(c, 3).alias(c) for c in "xyz"))


_WHOLE = "WITH sm AS MATERIALIZED (SELECT curve_id, (seq % 31) / 10.0 - 1.5 AS u, exp(-pow((seq % 31) / 10.0 - 1.5, 2) / 2) AS w, x, y, z FROM curve_points WHERE curve_id IN (SELECT curve_id FROM curve_points GROUP BY 1 HAVING count(DISTINCT seq % 31) >= 5))"


@query(("curve_points",), f"{_WHOLE}, {_fitted('sm', 'curve_id')} SELECT curve_id, " + ", ".join(f"{q(f'b{k}{c}', 3)} AS b{k}{c}" for k in range(3) for c in "xyz") + f", {q('nu', 3)} AS nu, {q('se', 3)} AS se FROM fit")
def a9_quadratic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weighted quadratic fits through all points of each curve that has five places or more: coefficients, degrees of freedom and error."""
    own = points(spark, d)
    many = own.groupBy("curve_id").agg(F.countDistinct(F.col("seq") % 31).alias("n")).where("n >= 5")
    u = (F.col("seq") % 31) / 10.0 - 1.5
    sm = components.cut(own.join(many, "curve_id", "left_semi").select("curve_id", u.alias("u"), F.exp(-u * u / 2).alias("w"), "x", "y", "z"))
    out = measure.quadratic_fit(sm, ["curve_id"])
    return out.select("curve_id", *(r(f"b{k}{c}", 3).alias(f"b{k}{c}") for k in range(3) for c in "xyz"), r("nu", 3).alias("nu"), r("se", 3).alias("se"))


@query(("fruits",), f"{_RANK}, er AS (SELECT plant_id, abs(degrees(0.01 * fruit_id) - 360.0 * round_even(degrees(0.01 * fruit_id) / 360.0, 0)) AS e FROM fr) SELECT plant_id, {q('avg(e)')} AS mean_error, {q('max(e)')} AS max_error FROM er GROUP BY plant_id")
def a12_accuracy(spark: SparkSession, d: str) -> DataFrame:
    f = fruits(spark, d)
    truth = f.withColumn("azimuth", F.col("azimuth") + 0.01 * F.col("fruit_id"))
    return measure.accuracy(f, truth).select("plant_id", r("mean_error").alias("mean_error"), r("max_error").alias("max_error"))


_EDGE = """WITH cn AS (SELECT plant_id, n AS corner, ox + (n & 1) * wx AS x, oy + ((n >> 1) & 1) * wy AS y, oz + ((n >> 2) & 1) * wz AS z FROM grids, (SELECT unnest(range(0, 8)) AS n)),
cam AS (SELECT c.plant_id, c.corner, c.x, c.y, c.z, f.* EXCLUDE (plant_id), {cam} FROM cn c JOIN frames f USING (plant_id)),
nrm AS (SELECT *, xc / d AS a, yc / d AS b FROM cam WHERE d > 0),
sub AS ({sub}),
ed AS (SELECT p.plant_id, p.frame_idx, p.corner * 3 + bit AS edge, p.width, p.height, p.u AS x1, p.v AS y1, o.u AS x2, o.v AS y2, o.u - p.u AS dx, o.v - p.v AS dy FROM sub p, (SELECT unnest(range(0, 3)) AS bit), sub o WHERE o.plant_id = p.plant_id AND o.frame_idx = p.frame_idx AND (p.corner >> bit) & 1 = 0 AND o.corner = p.corner + (1 << bit)),
cl AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN -x1 / dx WHEN dx < 0 THEN (width - x1) / dx ELSE 0.0 END, CASE WHEN dy > 0 THEN -y1 / dy WHEN dy < 0 THEN (height - y1) / dy ELSE 0.0 END) AS t0,
  least(1.0, CASE WHEN dx < 0 THEN -x1 / dx WHEN dx > 0 THEN (width - x1) / dx ELSE 1.0 END, CASE WHEN dy < 0 THEN -y1 / dy WHEN dy > 0 THEN (height - y1) / dy ELSE 1.0 END) AS t1
  FROM ed WHERE NOT (dx = 0 AND (x1 < 0 OR x1 > width)) AND NOT (dy = 0 AND (y1 < 0 OR y1 > height)))
""".format(cam=_CAM, sub=_SEEN.split("sub AS (")[1].split("),\npx")[0])


@query(("frames", "grids"), f"{_EDGE} SELECT plant_id, frame_idx, edge, {q('x1 + dx * t0', 3)} AS x1, {q('y1 + dy * t0', 3)} AS y1, {q('x1 + dx * t1', 3)} AS x2, {q('y1 + dy * t1', 3)} AS y2 FROM cl WHERE t0 <= t1")
def p8_box_edges(spark: SparkSession, d: str) -> DataFrame:
    return camera.project_boxes(load(spark, d, "grids"), frames(spark, d)).select("plant_id", "frame_idx", "edge", *(r(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(("fruits",), """SELECT plant_id, count(*) AS n_fruits, count(*) FILTER (isnan(phi)) AS n_flagged FROM (SELECT plant_id, CASE WHEN node_id % 11 = 0 THEN 'nan'::DOUBLE WHEN node_id % 7 = 0 THEN 'nan'::DOUBLE ELSE azimuth END AS phi FROM fruits) GROUP BY plant_id""")
def q6_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Degenerate fits lose both angles, an undefined azimuth only itself; both are flagged."""
    nan = F.lit(float("nan"))
    rows = load(spark, d, "fruits").select("plant_id", F.lit(1.0).alias("theta"), F.when(F.col("node_id") % 7 == 0, nan).otherwise(F.col("azimuth")).alias("phi"), (F.col("node_id") % 11 == 0).alias("degenerate"))
    return measure.flag_angles(rows).groupBy("plant_id").agg(F.count(F.lit(1)).alias("n_fruits"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"))


@query(("curve_points",), f"WITH ln AS (SELECT curve_id, count(*) / 2.0 AS length FROM curve_points GROUP BY 1) SELECT curve_id, {q('least(3.0, greatest(length - 6.0, 0.0))')} AS s0 FROM ln")
def q3_fit_position(spark: SparkSession, d: str) -> DataFrame:
    lengths = load(spark, d, "curve_points").groupBy("curve_id").agg((F.count(F.lit(1)) / 2.0).alias("length"))
    return measure.fit_position(lengths, 2.0, 1.5, 2.0).select("curve_id", r("s0").alias("s0"))


# --- whole plants: canes with five side shoots of known place

SHOOTS = skeleton.Params(h=3.0)
MID = SIDE // 2
_TIPS = "tp AS (SELECT plant_id, fruit, i, j, k FROM twig_voxels WHERE is_tip)"


def canes(spark: SparkSession, d: str) -> DataFrame:
    """The canes with debris around them, which every skeleton drops."""
    return load(spark, d, "littered")


def grown(spark: SparkSession, d: str) -> skeleton.Skeleton:
    return skeleton.skeleton(canes(spark, d), DIMS, SHOOTS)


def at_voxel(rows: DataFrame, sk: skeleton.Skeleton) -> DataFrame:
    """rows(plant_id, node_id, ...) with the voxel i, j, k of the node."""
    return rows.join(sk.nodes.select("plant_id", "node_id", "i", "j", "k"), ["plant_id", "node_id"])


def voxel_node(rows: DataFrame, sk: skeleton.Skeleton) -> DataFrame:
    """rows(plant_id, i, j, k) as plant_id, node_id."""
    return rows.select("plant_id", *(F.col(a).cast("long").alias(a) for a in "ijk")).join(sk.nodes, ["plant_id", "i", "j", "k"]).select("plant_id", "node_id")


def shown_tips(sk: skeleton.Skeleton) -> DataFrame:
    return at_voxel(sk.tips, sk).select("plant_id", "i", "j", "k")


_PARTS = """WITH RECURSIVE vox AS MATERIALIZED (SELECT DISTINCT plant_id, i, j, k FROM littered),
e AS MATERIALIZED (SELECT a.*, b.i AS i2, b.j AS j2, b.k AS k2 FROM vox a JOIN vox b ON a.plant_id = b.plant_id AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
flood AS (SELECT plant_id, i, j, k, i * 1000000 + j * 1000 + k AS o FROM vox UNION SELECT e.plant_id, e.i2, e.j2, e.k2, o FROM flood JOIN e USING (plant_id, i, j, k)),
lab AS (SELECT plant_id, i, j, k, min(o) AS label FROM flood GROUP BY ALL),
siz AS (SELECT plant_id, label, count(*) AS size FROM lab GROUP BY ALL)"""


@query(("littered",), f"{_PARTS}, best AS (SELECT plant_id, label FROM siz QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY size DESC, label) = 1) SELECT plant_id, i, j, k FROM lab SEMI JOIN best USING (plant_id, label)")
def i8_plant_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Each plant's largest component of voxels."""
    return components.keep_largest(canes(spark, d), ["plant_id"], graph.AXES)


@query(("littered",), f"{_PARTS} SELECT plant_id, label, size FROM siz")
def c1_plant_parts(spark: SparkSession, d: str) -> DataFrame:
    """The components of each plant's voxels, by their first voxel, and their sizes."""
    out = components.component_sizes(components.cell_components(canes(spark, d), ["plant_id"], graph.AXES), ["plant_id"])
    return out.select("plant_id", (F.col("label.i") * 1000000 + F.col("label.j") * 1000 + F.col("label.k")).alias("label"), "size")


@query(("voxels_seen",), "WITH seen AS (SELECT plant_id, max(n) AS most FROM voxels_seen GROUP BY 1) SELECT plant_id, 'no voxel above the threshold' AS reason FROM seen WHERE most < (SELECT max(most) FROM seen)")
def i8_empty_plants(spark: SparkSession, d: str) -> DataFrame:
    """At a threshold that only the fullest plants reach, the others are named, not lost."""
    seen = load(spark, d, "voxels_seen")
    return skeleton.empty_plants(seen, seen.where(F.col("n") >= seen.agg(F.max("n")).first()[0]))


@query(("canes", "twig_voxels"), f"""WITH {_TIPS} SELECT plant_id, 'tip' AS part, i, j, k, true AS right_place FROM tp UNION ALL SELECT plant_id, 'root', {MID}, {MID}, 0, true FROM plants UNION ALL SELECT plant_id, 'top', {MID}, {MID}, {SIDE - 1}, true FROM plants
  UNION ALL SELECT plant_id, 'stem', {MID}, {MID}, k, true FROM plants, levels UNION ALL SELECT plant_id, 'branch', i, j, k, true FROM tp""")
def g17_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Root, top, tips, stem nodes, and for each branch its last node and whether it begins on the stem and ends at its tip."""
    sk = grown(spark, d)
    one = lambda rows, part: at_voxel(rows, sk).select("plant_id", F.lit(part).alias("part"), "i", "j", "k", F.lit(True).alias("right_place"))
    ends = sk.branches.groupBy("plant_id", "tip").agg(F.min_by("node_id", "seq").alias("first"), F.max_by("node_id", "seq").alias("node_id"))
    stem = sk.stem.select("plant_id", F.col("node_id").alias("first"), F.lit(True).alias("on_stem"))
    ends = at_voxel(ends.join(stem, ["plant_id", "first"], "left"), sk)
    branches = ends.select("plant_id", F.lit("branch").alias("part"), "i", "j", "k", (F.coalesce("on_stem", F.lit(False)) & (F.col("node_id") == F.col("tip"))).alias("right_place"))
    return one(sk.tips, "tip").union(one(sk.root, "root")).union(one(sk.top, "top")).union(one(sk.stem, "stem")).union(branches)


@query(("canes", "twig_voxels"), f"WITH {_TIPS} SELECT t.plant_id, t.fruit, {MID} AS i, {MID} AS j, CASE WHEN t.fruit % 2 = 0 THEN 1 ELSE 2 END AS k, CASE WHEN t.fruit % 2 = 0 THEN true END AS passes, true AS ends FROM tp t WHERE t.fruit < 3")
def g13_waypoint_paths(spark: SparkSession, d: str) -> DataFrame:
    """Branches tied to a stem node, every second one also to two waypoints below: where they begin, and whether they pass and end right."""
    sk, tips = grown(spark, d), load(spark, d, "twig_voxels").where("is_tip and fruit < 3")
    spot = lambda k: voxel_node(load(spark, d, "plants").select("plant_id", F.lit(MID).alias("i"), F.lit(MID).alias("j"), F.lit(k).alias("k")), sk)
    ends = tips.select("plant_id", "fruit", *(F.col(a).cast("long").alias(a) for a in "ijk")).join(sk.nodes, ["plant_id", "i", "j", "k"]).select("plant_id", "fruit", "node_id")
    for k, name in ((1, "n1"), (2, "n2"), (3, "n3")):
        ends = ends.join(spot(k).withColumnRenamed("node_id", name), "plant_id")
    even = F.col("fruit") % 2 == 0
    tied = components.cut(ends.select("plant_id", "fruit", "node_id", F.when(even, F.col("n1")).otherwise(F.col("n2")).alias("stem_target"), F.when(even, F.array("n3", "n2")).alias("waypoints")))
    moved = skeleton.change_tips(sk, tied)
    way = moved.branches.groupBy("plant_id", "tip").agg(F.min_by("node_id", "seq").alias("first"), F.max_by("node_id", "seq").alias("last"), F.array_sort(F.collect_list(F.struct("seq", "node_id")))["node_id"].alias("path"))
    met = way.join(tied.withColumnRenamed("node_id", "tip"), ["plant_id", "tip"])
    first, last = F.array_position("path", F.get("waypoints", F.lit(0))), F.size("path") + 1 - F.array_position(F.reverse("path"), F.get("waypoints", F.lit(1)))
    out = met.select("plant_id", "fruit", F.col("first").alias("node_id"), F.when(F.col("waypoints").isNotNull(), (first > 0) & (last > first)).alias("passes"), (F.col("last") == F.col("tip")).alias("ends"))
    return at_voxel(out, moved).select("plant_id", "fruit", "i", "j", "k", "passes", "ends")


@query(("canes", "twig_voxels"), f"""WITH {_TIPS} SELECT plant_id, 'root' AS moved, 'tip' AS part, i, j, k FROM tp UNION ALL SELECT plant_id, 'root', 'stem', {MID}, {MID}, k FROM plants, levels WHERE k >= 2 UNION ALL SELECT plant_id, 'root', 'tip', {MID}, {MID}, 0 FROM plants WHERE false
  UNION ALL SELECT plant_id, 'top', 'stem', {MID}, {MID}, k FROM plants, levels WHERE k <= 20 UNION ALL SELECT plant_id, 'top', 'tip', i, j, k FROM tp""")
def g21_moved_ends(spark: SparkSession, d: str) -> DataFrame:
    """Stem and tips after the root has moved up two voxels, and after the top has moved down three."""
    sk, out = grown(spark, d), None
    spot = lambda k: voxel_node(load(spark, d, "plants").select("plant_id", F.lit(MID).alias("i"), F.lit(MID).alias("j"), F.lit(k).alias("k")), sk)
    for name, new in (("root", skeleton.move_root(sk, spot(2), DIMS, SHOOTS)), ("top", skeleton.move_top(sk, spot(20), SHOOTS))):
        for part, rows in (("stem", new.stem), ("tip", new.tips)):
            one = at_voxel(rows, new).select("plant_id", F.lit(name).alias("moved"), F.lit(part).alias("part"), "i", "j", "k")
            out = one if out is None else out.union(one)
    return out


@query(("canes", "twig_voxels"), f"""WITH {_TIPS}, shorter AS (SELECT plant_id, fruit, i, j, k FROM twig_voxels v WHERE r = (SELECT max(r) - 1 FROM twig_voxels w WHERE w.plant_id = v.plant_id AND w.fruit = v.fruit))
  SELECT plant_id, 'conductance' AS changed, i, j, k FROM tp UNION ALL SELECT plant_id, 'back', i, j, k FROM tp UNION ALL SELECT plant_id, 'threshold', i, j, k FROM shorter""")
def g23_changed_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Tips after a huge prominence (none is left), after the first one again, after other conductance, and after a threshold that takes the last step of each shoot."""
    sk, out = grown(spark, d), None
    tips = load(spark, d, "twig_voxels").where("is_tip").select("plant_id", *(F.col(a).cast("long").alias(a) for a in "ijk"))
    # A step is the tip, and the voxels that link it to the one before: below it, and beside it on slanting shoots.
    steps = tips.withColumn("a", F.explode(F.array(F.lit(0), F.signum(F.col("j") - MID).cast("int")))).withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    away = lambda j: F.greatest(F.abs(F.col("i") - MID), F.abs(j - MID))
    few = steps.where(away(F.col("j") - F.col("a")) == away(F.col("j"))).select("plant_id", "i", (F.col("j") - F.col("a")).alias("j"), (F.col("k") - F.col("b")).alias("k"))
    huge = skeleton.change_prominence(sk, 500.0)
    changed = {
        "huge": huge, "back": skeleton.change_prominence(huge, SHOOTS.h), "conductance": skeleton.change_conductance(sk, replace(SHOOTS, beta=3.0, nu_min=0.05)),
        "threshold": skeleton.change_threshold(sk, canes(spark, d).join(few, ["plant_id", "i", "j", "k"], "left_anti"), DIMS, SHOOTS),
    }
    for name, new in changed.items():
        one = shown_tips(new).select("plant_id", F.lit(name).alias("changed"), "i", "j", "k")
        out = one if out is None else out.union(one)
    return out


THIN = measurement.CurveParams(sigma_stem=3.0, sigma_branch=1.0)
# The shoots' own ways in half voxels, so that curves of width 2 here are those of width 1 there: the junction, the stem's voxel, and one a step.
# Steps rise as late as their links allow, and the tip is the shoot's last voxel.
_SHOOT_POINTS = f"""shoot_points AS (SELECT plant_id * 5 + fruit AS curve_id, r AS seq, (1 + 2 * dx * greatest(r, 0))::DOUBLE AS x, (1 + 2 * dy * greatest(r, 0))::DOUBLE AS y, (2 * (height + CASE WHEN r = len THEN r // 3 ELSE greatest(r - 1, 0) // 3 END) + 1 - {SIDE})::DOUBLE AS z
  FROM twigs t JOIN ways w ON w.way = t.way JOIN (SELECT unnest(range(-1, 9)) AS r) u ON r <= len)"""
_SHOOT_FITS = f"""WITH {_SHOOT_POINTS}, {_DENSE[5:].replace("FROM curve_points", "FROM shoot_points")},
fw AS MATERIALIZED (SELECT *, greatest(0.0, c0 - 12.0) AS s_min, least(len, c0 + 12.0) AS s_max FROM (SELECT curve_id, len, least(4.0, greatest(len - 12.0, 0.0)) AS c0 FROM ln)),
fs AS MATERIALIZED (SELECT curve_id, c0, k, s_min + (s_max - s_min) * k / 30.0 AS s FROM (SELECT *, unnest(range(0, 31)) AS k FROM fw)), {_s_to_t("ft", "fs", "c0 k s")}, {_smoothed("fk", "ft", "c0, k, s")},
sm AS MATERIALIZED (SELECT curve_id, (s - c0) / 4.0 AS u, exp(-pow((s - c0) / 4.0, 2) / 2) AS w, x, y, z FROM fk), {_fitted("sm", "curve_id")},
th AS MATERIALIZED (SELECT t.plant_id, t.height, t.side, f.*, fw.len, fw.c0, fw.s_min, fw.s_max, row_number() OVER by_height AS fruit_id, lag(height) OVER by_height AS below, b1x / m AS tx, b1y / m AS ty, b1z / m AS tz, acos(b1z / m) AS theta, atan2(b1y, b1x) AS phi
  FROM twigs t JOIN (SELECT *, sqrt(b1x*b1x + b1y*b1y + b1z*b1z) AS m FROM fit) f ON f.curve_id = plant_id * 5 + fruit JOIN fw ON fw.curve_id = f.curve_id WINDOW by_height AS (PARTITION BY plant_id ORDER BY height))"""
# The stems are straight and upright, so a fruit's errors are its branch's alone.
_SHOOT_ANGLES = f"""SELECT plant_id, fruit_id, CASE WHEN side = 1 THEN 'ccw' ELSE 'cw' END AS orientation, false AS flagged, height::DOUBLE AS arc, (height - below)::DOUBLE AS internode, {q("len / 2")} AS length, {q("degrees(theta)", 3)} AS polar,
  {q("degrees(phi)", 3)} - 360 * floor({q("degrees(phi)", 3)} / 360) AS azimuth, {q("(CASE WHEN side = 1 THEN 1 ELSE -1 END) * degrees(phi - lag(phi) OVER by_fruit)", 3)} AS turn, {q("degrees(se / sqrt(2.0))")} AS se_polar, {q("degrees(se / sqrt(2.0) / sin(theta))")} AS se_azimuth, 0.0::DOUBLE AS cov
  FROM th WINDOW by_fruit AS (PARTITION BY plant_id ORDER BY fruit_id)"""
_SHOOT_FRUITS = f"SELECT * EXCLUDE (turn), turn - 360 * floor(turn / 360) AS div_angle FROM ({_SHOOT_ANGLES})"


def in_full(rows: DataFrame) -> DataFrame:
    """All that is measured of the fruits, rounded; angles in degrees from 0 to below 360 after rounding."""
    turn = lambda c: F.pmod(r(c, 3), F.lit(360.0))
    return rows.select(
        "plant_id", F.col("fruit_id").cast("long").alias("fruit_id"), "orientation", "flagged", r("arc").alias("arc"), r("internode").alias("internode"), r("length").alias("length"), r(F.degrees("polar"), 3).alias("polar"),
        turn(F.degrees("azimuth")).alias("azimuth"), turn(F.col("div_angle")).alias("div_angle"), r("se_polar").alias("se_polar"), r("se_azimuth").alias("se_azimuth"), r("cov").alias("cov"),
    )


@query(("twigs", "ways"), f"{_SHOOT_FITS} {_SHOOT_FRUITS}")
def q9_measurements(spark: SparkSession, d: str) -> DataFrame:
    """From occupied voxels to fruits; the SQL measures the shoots' own ways, which it is told, with the same fits."""
    c = measurement.smoothed(grown(spark, d), load(spark, d, "grids"), THIN)
    return in_full(measurement.measured(c, 1.0, THIN))


_WINDOW = f"""wq AS MATERIALIZED (SELECT curve_id, k, CASE WHEN k < 0 THEN c0 ELSE s_min + (s_max - s_min) * k / 24.0 END AS s FROM (SELECT *, unnest(range(-1, 25)) AS k FROM fw)), {_s_to_t("wt", "wq", "k s")}, {_smoothed("wk", "wt", "k, s")},
ap AS (SELECT curve_id, count(*) - 1 AS points, max(CASE WHEN k < 0 THEN x END) / 2 AS fx, max(CASE WHEN k < 0 THEN y END) / 2 AS fy, max(CASE WHEN k < 0 THEN z END) / 2 AS fz,
  max(CASE WHEN k >= 0 THEN sqrt({" + ".join(f"pow({c} - (b0{c} + b1{c} * (s - c0) / 4 + b2{c} * pow((s - c0) / 4, 2)), 2)" for c in "xyz")}) END) / 2 AS apart FROM wk JOIN (SELECT curve_id, c0, {", ".join(f"b{k}{c}" for k in range(3) for c in "xyz")} FROM th) USING (curve_id) GROUP BY 1)"""


@query(("twigs", "ways"), f"""{_SHOOT_FITS}, {_WINDOW} SELECT plant_id, fruit_id, points::INT AS points, {q("apart", 3)} AS apart, 0.5::DOUBLE AS px, 0.5::DOUBLE AS py, height + 0.5::DOUBLE - {SIDE // 2} AS pz, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 1.0::DOUBLE AS sz,
  {", ".join(f"{q(f't{c}', 3)} AS b{c}" for c in "xyz")}, {", ".join(f"{q(f'f{c}', 3)} AS f{c}" for c in "xyz")} FROM th JOIN ap USING (curve_id)""")
def q10_fit_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Behind each fruit's angles: junction, tangents of stem and branch, the place of the fit, and how far the curve and its quadratic part in the window."""
    c = measurement.smoothed(grown(spark, d), load(spark, d, "grids"), THIN)
    rows, window = measurement.fit_geometry(c, 1.0, THIN)
    apart = window.groupBy("plant_id", "tip").agg(F.count(F.lit(1)).alias("points"), F.max(F.sqrt(sum((F.col(k) - F.col(f"q{k}")) * (F.col(k) - F.col(f"q{k}")) for k in "xyz"))).alias("apart"))
    met = rows.join(apart, ["plant_id", "tip"])
    ranked = met.withColumn("fruit_id", F.row_number().over(Window.partitionBy("plant_id").orderBy("pz")).cast("long"))
    return ranked.select("plant_id", "fruit_id", F.col("points").cast("int").alias("points"), *(r(c, 3).alias(c) for c in ("apart", *(f"{p}{k}" for p in "psbf" for k in "xyz"))))


@query(("twigs", "ways"), f"{_SHOOT_FITS} SELECT s.changed, r.* FROM ({_SHOOT_FRUITS}) r, (VALUES ('branches'), ('stems')) s(changed)")
def k9_resmoothed(spark: SparkSession, d: str) -> DataFrame:
    """The measurement after other smoothing of the branches, and of the stems, which are straight under both."""
    sk, grids = grown(spark, d), load(spark, d, "grids")
    first, out = measurement.smoothed(sk, grids, measurement.CurveParams(sigma_stem=3.0, sigma_branch=1.5)), None
    before = measurement.CurveParams(sigma_stem=3.0, sigma_branch=1.5)
    for name, after in (("branches", THIN), ("stems", replace(THIN, sigma_stem=4.0))):
        c = measurement.resmoothed(sk, grids, first, before, after)
        one = in_full(measurement.measured(c, 1.0, after)).withColumn("changed", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(("twigs",), "SELECT plant_id, 5 AS fruits, 0 AS changed, true AS same_ends FROM (SELECT DISTINCT plant_id FROM twigs)")
def q12_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons rebuilt from saved root, top and tips have the same stems and branches; rows of the other kind of run are not used."""
    sk = grown(spark, d)
    saved = components.cut(skeleton.saved_state(sk).withColumn("complete", F.col("plant_id") % 2 == 0))
    again = skeleton.reopened(canes(spark, d), DIMS, saved, True, SHOOTS)
    ways = lambda x: x.branches.select("plant_id", "tip", "seq", "node_id").union(x.stem.select("plant_id", F.lit(0).cast("long").alias("tip"), "seq", "node_id"))
    rows = [components.cut(ways(x)) for x in (sk, again)]
    lost = rows[0].exceptAll(rows[1]).unionByName(rows[1].exceptAll(rows[0])).groupBy("plant_id").agg(F.count(F.lit(1)).alias("changed"))
    ends = [x.root.select("plant_id", F.col("node_id").alias(f"r{k}")).join(x.top.select("plant_id", F.col("node_id").alias(f"t{k}")), "plant_id") for k, x in enumerate((sk, again))]
    fruits = again.branches.groupBy("plant_id").agg(F.countDistinct("tip").cast("int").alias("fruits"))
    met = fruits.join(lost, "plant_id", "left").join(ends[0], "plant_id").join(ends[1], "plant_id")
    return met.select("plant_id", "fruits", F.coalesce("changed", F.lit(0)).cast("int").alias("changed"), ((F.col("r0") == F.col("r1")) & (F.col("t0") == F.col("t1"))).alias("same_ends"))


# --- results, updates, work lists


def old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("plant_id"), F.lit(0).alias("version"), F.col("o_custkey").alias("value"), (F.col("o_custkey") % 3 == 0).alias("complete"))
    new = o.where("o_orderkey % 5 < 2").select((F.col("o_orderkey") + 1).alias("plant_id"), F.lit(1).alias("version"), F.col("o_custkey").alias("value"), F.lit(False).alias("complete"))
    return old, new


_ON = "WITH old AS (SELECT o_orderkey AS plant_id, 0 AS version, o_custkey AS value, o_custkey % 3 = 0 AS full_ FROM orders), new AS (SELECT o_orderkey + 1 AS plant_id, 1 AS version, o_custkey AS value, false AS full_ FROM orders WHERE o_orderkey % 5 < 2)"


@query((), f"{_ON} SELECT plant_id, version, value, full_ AS complete FROM old ANTI JOIN new USING (plant_id) UNION ALL SELECT * FROM new".replace("SELECT * FROM new", "SELECT plant_id, version, value, full_ FROM new"))
def u1_upsert(spark: SparkSession, d: str) -> DataFrame:
    return results.upsert(*old_new(spark, d), ["plant_id"])


@query((), f"{_ON}, sh AS (SELECT plant_id FROM old WHERE full_), ok AS (SELECT * FROM new ANTI JOIN sh USING (plant_id)) SELECT plant_id, version, value, false AS rejected FROM old ANTI JOIN ok USING (plant_id) UNION ALL SELECT plant_id, version, value, false FROM ok UNION ALL SELECT plant_id, version, value, true FROM new SEMI JOIN sh USING (plant_id)")
def p16_guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    good, bad = results.guarded_upsert(*old_new(spark, d), ["plant_id"], "complete")
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).drop("complete")


@query((), f"{_ON} SELECT plant_id, version, value FROM old ANTI JOIN new USING (plant_id)")
def u4_remove(spark: SparkSession, d: str) -> DataFrame:
    return results.remove(*old_new(spark, d), ["plant_id"]).drop("complete")


@query((), "SELECT n.o_orderkey AS plant_id, n.o_custkey AS node_id, coalesce(o.o_custkey % 7, 0) AS stem_target FROM orders n LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) o ON o.o_orderkey = n.o_orderkey")
def u6_keep_options(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("plant_id"), F.col("o_custkey").alias("node_id"))
    old = o.where("plant_id % 3 = 0").withColumn("stem_target", F.col("node_id") % 7)
    return results.keep_options(o.withColumn("stem_target", F.lit(0).cast("long")), old, ["plant_id", "node_id"], ["stem_target"])


def scans_done(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("plant_id"), F.col("c_nationkey").alias("grp")), load(spark, d, "orders").select(F.col("o_custkey").alias("plant_id"))


@query((), "SELECT c_custkey AS plant_id, c_nationkey AS grp, c_custkey IN (SELECT o_custkey FROM orders) AS finished FROM customer")
def j11_done_and_to_do(spark: SparkSession, d: str) -> DataFrame:
    pair = scans_done(spark, d)
    return results.done(*pair).withColumn("finished", F.lit(True)).unionByName(results.to_do(*pair).withColumn("finished", F.lit(False)))


@query((), "SELECT coalesce(min(c_custkey) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)), min(c_custkey)) AS plant_id FROM customer")
def t3_next_plant(spark: SparkSession, d: str) -> DataFrame:
    return results.next_plant(*scans_done(spark, d))


@query((), "SELECT c_custkey AS plant_id, coalesce(lag(c_custkey) OVER w, max(c_custkey) OVER ()) AS previous, coalesce(lead(c_custkey) OVER w, min(c_custkey) OVER ()) AS next FROM customer WINDOW w AS (ORDER BY c_custkey)")
def t4_around(spark: SparkSession, d: str) -> DataFrame:
    return results.around(scans_done(spark, d)[0])


@query(("images",), "SELECT plant_id, frame_idx, row_number() OVER (PARTITION BY plant_id ORDER BY name) AS place FROM (SELECT plant_id, frame_idx, (frame_idx * 7919) % 10007 AS name FROM images)")
def t2_sorted_images(spark: SparkSession, d: str) -> DataFrame:
    """The images of each scan numbered by their name, which is not the order in which they come."""
    own = load(spark, d, "images").select("plant_id", "frame_idx", F.format_string("%05d_rgb", F.col("frame_idx") * 7919 % 10007).alias("stem"))
    return scans.numbered(own.select("plant_id", "stem", F.col("frame_idx").alias("own"))).select("plant_id", F.col("own").alias("frame_idx"), F.col("frame_idx").alias("place"))


@query((), f"{_ON} SELECT plant_id, version, value FROM old ANTI JOIN new USING (plant_id) UNION ALL SELECT plant_id, version, value FROM new")
def u5_replaced_tips(spark: SparkSession, d: str) -> DataFrame:
    """A plant's tips are replaced whole."""
    return results.replace_plants(*old_new(spark, d)).drop("complete")


@query(("voxels_seen",), "SELECT v.plant_id, i, j, k FROM voxels_seen v JOIN (SELECT plant_id, max(n) AS most FROM voxels_seen GROUP BY 1) USING (plant_id) WHERE n >= CASE WHEN plant_id % 2 = 0 THEN 1 ELSE least(7, most) END")
def s8_binarise_counts(spark: SparkSession, d: str) -> DataFrame:
    seen = load(spark, d, "voxels_seen")
    meta = load(spark, d, "plants").select("plant_id", F.when(F.col("plant_id") % 2 == 0, "carving").otherwise("averaging").alias("method"), F.lit(7).alias("threshold"))
    return results.binarise_counts(seen, meta)


@query((), "SELECT o_orderkey AS plant_id, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS value, CASE WHEN o_orderkey % 7 > 0 THEN 'new' END AS note, CASE WHEN o_orderkey % 7 = 1 THEN '' ELSE 'gone' END AS dropped, CASE WHEN o_orderkey % 7 = 0 THEN 'value' ELSE '' END AS missing FROM orders")
def s14_restore(spark: SparkSession, d: str) -> DataFrame:
    """Dumps with a field that the target lacks, without one that has a default, and without one that has none: rows and report."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("plant_id"), F.col("o_custkey").alias("value"), F.lit(1).alias("gone"))
    schema = T.StructType([T.StructField("value", T.LongType()), T.StructField("note", T.StringType())])
    kind, key = F.col("plant_id") % 7, ["plant_id"]
    plain = results.to_plain(rows.where(kind > 1), key).unionByName(results.to_plain(rows.where(kind == 0).drop("value"), key)).unionByName(results.to_plain(rows.where(kind == 1).drop("gone"), key))
    good, report = results.from_plain(plain, key, schema, {"note": "new"})
    both = good.join(report, key, "full")
    return both.select("plant_id", "value", "note", *(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("dropped", "missing")))


@query((), "SELECT 'narrow' AS target, o_orderkey AS plant_id, o_custkey, o_orderstatus FROM orders UNION ALL SELECT 'narrow', o_orderkey, o_custkey, NULL FROM orders")
def s13_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a dump and restore changes: none in their own schema, all in one that cannot hold a column's values."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("plant_id"), "o_custkey", "o_orderstatus")
    narrow = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.IntegerType())])
    out = [results.round_trip_differences(rows, ["plant_id"], s).withColumn("target", F.lit(name)) for name, s in (("own", None), ("narrow", narrow))]
    return out[0].unionByName(out[1])
