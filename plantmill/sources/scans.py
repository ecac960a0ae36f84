"""Scan folders as tables: images, camera poses, camera models and voxel metadata.

A scan is `<plant>/images/NNNNN_rgb.jpg` with `<plant>/metadata/images/NNNNN_rgb.json` for each image. Only file names are
listed where names suffice; JSON files are read whole, one row each, and parsed with fixed schemas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE = r"([^/]+)/images/(\d{5}_rgb)\.jpg$"
METADATA = r"([^/]+)/metadata/images/([^/]+)\.json$"
CAMERA = "map<string, struct<width: int, height: int, model: string, params: array<double>>>"
POSES = "map<string, struct<rotmat: array<array<double>>, tvec: array<double>>>"
VOXELS = "struct<task_params: struct<bounding_box: struct<x: array<double>, y: array<double>, z: array<double>>, voxel_size: double, type: string, method: string, missing_images_threshold: int>>"


def _listed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path of every file below root with a name like `name`; contents stay unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")


def _parts(pattern: str) -> list[Column]:
    return [F.regexp_extract("path", pattern, 1).alias("plant_id"), F.regexp_extract("path", pattern, 2).alias("stem")]


def _whole(spark: SparkSession, root: str, name: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return text.select("value", F.col("_metadata.file_path").alias("path"))


def numbered(found: DataFrame) -> DataFrame:
    """found(plant_id, stem, ...) with frame_idx: the rank of the name within its plant."""
    return found.withColumn("frame_idx", F.row_number().over(Window.partitionBy("plant_id").orderBy("stem")))


def image_list(paths: DataFrame) -> DataFrame:
    """plant_id, stem, frame_idx of the images among paths(path), numbered by name within a plant."""
    return numbered(paths.select(*_parts(IMAGE)).where("plant_id <> ''"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """The images of all scans below root."""
    return image_list(_listed(spark, root, "*_rgb.jpg"))


def validity(own: DataFrame, paths: DataFrame) -> DataFrame:
    """plant_id, n_images, n_missing, valid: a scan has an image, and metadata among paths(path) for each of its images."""
    meta = paths.select(*_parts(METADATA)).where("plant_id <> ''").distinct().withColumn("has", F.lit(1))
    n, bad = F.count(F.lit(1)), F.count(F.when(F.col("has").isNull(), 1))
    return own.join(meta, ["plant_id", "stem"], "left").groupBy("plant_id").agg(n.alias("n_images"), bad.alias("n_missing"), ((n > 0) & (bad == 0)).alias("valid"))


def validate_scans(spark: SparkSession, root: str) -> DataFrame:
    return validity(images(spark, root), _listed(spark, root, "*.json"))


def folder_kind(paths: DataFrame, valid: DataFrame, root: str) -> DataFrame:
    """kind, plant_id for image paths(path) below root and valid(plant_id): `single` with the folder's own name if root is a valid scan,
    else `experiment` with each valid scan right below it; else one row `invalid` with no plant."""
    here, parts = root.rstrip("/").rsplit("/", 1)[-1], F.split("path", "/")
    own = paths.select(*_parts(IMAGE), parts.alias("parts")).where("plant_id <> ''")
    # How far below the root a scan lies: its folder is the root itself, or a folder right in it.
    own = own.select("plant_id", F.get("parts", F.size("parts") - 4).alias("above")).distinct()
    good = own.join(valid.select("plant_id"), "plant_id", "left_semi")
    single = good.where(F.col("plant_id") == here).select(F.lit(0).alias("rank"), F.lit("single").alias("kind"), "plant_id")
    below = good.where(F.col("above") == here).select(F.lit(1).alias("rank"), F.lit("experiment").alias("kind"), "plant_id")
    none = paths.sparkSession.range(1).select(F.lit(2).alias("rank"), F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("plant_id"))
    found = single.union(below).union(none)
    return found.join(found.agg(F.min("rank").alias("rank")), "rank").select("kind", "plant_id")


def discover_scans(spark: SparkSession, root: str) -> DataFrame:
    return folder_kind(_listed(spark, root, "*_rgb.jpg"), validate_scans(spark, root).where("valid"), root)


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """plant_id, frame_idx, row, col (from 1), r, g, b in 0 to 1: the pixels of all images that Spark's image reader can decode."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_rgb.jpg").option("dropInvalid", "true").load(root)
    named = raw.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data").select(*_parts(IMAGE), "height", "width", "nChannels", "data")
    return decoded(named.join(images(spark, root), ["plant_id", "stem"]))


def decoded(rows: DataFrame) -> DataFrame:
    """The pixels of rows(plant_id, frame_idx, height, width, nChannels, data), data as Spark's image reader gives it."""
    own = rows.select("plant_id", "frame_idx", "height", "width", "nChannels", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for im in batch.itertuples():
                # Rows of blue, green, red bytes; a grey image has one byte.
                whole = np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, im.nChannels)
                blue, green, red = (whole[:, :, min(k, im.nChannels - 1)] for k in range(3))
                row, col = np.divmod(np.arange(im.height * im.width), im.width)
                yield pd.DataFrame({"plant_id": im.plant_id, "frame_idx": im.frame_idx, "row": row + 1, "col": col + 1, "r": red.ravel() / 255, "g": green.ravel() / 255, "b": blue.ravel() / 255})

    return own.mapInPandas(run, f"plant_id {own.schema['plant_id'].dataType.simpleString()}, frame_idx int, row long, col long, r double, g double, b double")


def poses_in(texts: DataFrame, own: DataFrame) -> DataFrame:
    """plant_id, frame_idx, stem, x, y, z: the first three numbers of each image's approximate pose in texts(path, value)."""
    raw = texts.select(*_parts(METADATA), F.from_json("value", "struct<approximate_pose: array<double>>")["approximate_pose"].alias("p"))
    return own.join(raw, ["plant_id", "stem"]).select("plant_id", "frame_idx", "stem", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")))


def cnc_poses(spark: SparkSession, root: str) -> DataFrame:
    return poses_in(_whole(spark, root, "*_rgb.json"), images(spark, root))


def frames_in(cameras: DataFrame, poses: DataFrame, own: DataFrame) -> DataFrame:
    """The frames of all plants from the texts(path, value) of both kinds of files: rotation, translation and camera "1" with eight parameters, joined to the image list by name."""
    at = F.regexp_extract("path", r"([^/]+)/[^/]*cameras\.json$", 1).alias("plant_id")
    cameras = cameras.select(at, F.from_json("value", CAMERA)["1"].alias("c"))
    at = F.regexp_extract("path", r"([^/]+)/[^/]*images\.json$", 1).alias("plant_id")
    poses = poses.select(at, F.explode(F.from_json("value", POSES)).alias("img_name", "pose"))
    poses = poses.withColumn("stem", F.regexp_replace("img_name", r"\.[^.]*$", ""))
    met = own.join(poses, ["plant_id", "stem"]).join(cameras, "plant_id")
    rotation = [(F.get(F.get("pose.rotmat", F.lit(a)), F.lit(b)) + 0.0).alias(f"r{a + 1}{b + 1}") for a in range(3) for b in range(3)]  # no negative zero
    shift = [(F.get("pose.tvec", F.lit(k)) + 0.0).alias(f"t{k + 1}") for k in range(3)]
    lens = [(F.get("c.params", F.lit(k)) + 0.0).alias(n) for k, n in enumerate(("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"))]
    return met.select("plant_id", "frame_idx", "img_name", *rotation, *shift, "c.width", "c.height", *lens)


def camera_frames(spark: SparkSession, root: str) -> DataFrame:
    return frames_in(_whole(spark, root, "*cameras.json"), _whole(spark, root, "*images.json"), images(spark, root))


def voxels_in(texts: DataFrame, own: DataFrame) -> DataFrame:
    """plant_id, ox.., wx.., voxel_size, method, threshold from texts(path, value): type, else method, else averaging; images less those that may miss (2)."""
    at = F.regexp_extract("path", r"([^/]+)/metadata/Voxels[^/]*\.json$", 1).alias("plant_id")
    raw = texts.select(at, F.from_json("value", VOXELS)["task_params"].alias("t"))
    count = own.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))
    ends = {c: F.array_sort(F.col(f"t.bounding_box.{c}")) for c in "xyz"}
    low = [F.get(e, F.lit(0)).alias(f"o{c}") for c, e in ends.items()]
    wide = [(F.get(e, F.lit(1)) - F.get(e, F.lit(0))).alias(f"w{c}") for c, e in ends.items()]
    method = F.coalesce("t.type", "t.method", F.lit("averaging")).alias("method")
    return raw.join(count, "plant_id").select("plant_id", *low, *wide, "t.voxel_size", method, (F.col("n") - F.coalesce("t.missing_images_threshold", F.lit(2))).alias("threshold"))


def voxel_metadata(spark: SparkSession, root: str) -> DataFrame:
    return voxels_in(_whole(spark, root, "Voxels*.json"), images(spark, root))
