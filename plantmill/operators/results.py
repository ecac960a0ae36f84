"""Keyed updates, work lists and exports of results. Snapshots are never overwritten in place: each call returns a new table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmill.operators.components import cut, whole_unions


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    whole_unions(old.sparkSession)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], protected: str) -> tuple[DataFrame, DataFrame]:
    """The upsert of rows whose key is not protected in old (`protected` is a boolean column there), and the rejected rows."""
    shut = old.where(F.col(protected)).select(*keys).distinct()
    return upsert(old, new.join(shut, keys, "left_anti"), keys), new.join(shut, keys, "left_semi")


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of gone; unknown keys change nothing."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_plants(old: DataFrame, new: DataFrame) -> DataFrame:
    """The plants of new take all their rows from new."""
    return upsert(old, new, ["plant_id"])


def keep_options(found: DataFrame, old: DataFrame, keys: list[str], options: list[str]) -> DataFrame:
    """found with the options that hand-made rows of the same key carry in old."""
    had = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in options))
    return found.join(had, keys, "left").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in options))


def done(scans: DataFrame, results: DataFrame) -> DataFrame:
    return scans.join(results.select("plant_id").distinct(), "plant_id", "left_semi")


def to_do(scans: DataFrame, results: DataFrame) -> DataFrame:
    return scans.join(results.select("plant_id").distinct(), "plant_id", "left_anti")


def next_plant(scans: DataFrame, results: DataFrame) -> DataFrame:
    """One row, plant_id: the first plant without a result; the first of all when none is left."""
    had = results.select("plant_id").distinct().withColumn("_had", F.lit(True))
    both = scans.select("plant_id").join(had, "plant_id", "left")
    return both.agg(F.coalesce(F.min(F.when(F.col("_had").isNull(), F.col("plant_id"))), F.min("plant_id")).alias("plant_id"))


def around(scans: DataFrame) -> DataFrame:
    """plant_id, previous, next: the plants in cyclic order.

    Ids are sorted by ranges; only the first and last id of each range meet in one task.
    """
    ids = cut(scans.select("plant_id").distinct().repartitionByRange("plant_id").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy("plant_id")
    ends = ids.groupBy("_p").agg(F.min("plant_id").alias("low"), F.max("plant_id").alias("high"))
    order, whole = Window.orderBy("low"), Window.partitionBy()
    ends = ends.select("_p", F.coalesce(F.lag("high").over(order), F.max("high").over(whole)).alias("before"), F.coalesce(F.lead("low").over(order), F.min("low").over(whole)).alias("after"))
    met = ids.join(F.broadcast(ends), "_p")  # one row for each range
    return met.select("plant_id", F.coalesce(F.lag("plant_id").over(w), F.col("before")).alias("previous"), F.coalesce(F.lead("plant_id").over(w), F.col("after")).alias("next"))


# The header of the CSV export, and the column that each name stands for.
CSV = {
    "plant_id": "plant_id", "fruit_id": "fruit_id", "fruit_length (mm)": "length", "polar (rad)": "polar", "se_polar (°)": "se_polar", "azimuth (rad)": "azimuth",
    "se_azimuth (°)": "se_azimuth", "cov_polar_azimuth (°²)": "cov", "flagged": "flagged", "internode (mm)": "internode", "div_angle (°)": "div_angle", "chirality": "orientation",
}
VALUES = ["length", "polar", "azimuth", "se_polar", "se_azimuth", "cov", "flagged"]


def export_rows(fruits: DataFrame) -> DataFrame:
    """The rows of the CSV export with the keys that sort them: plant and winding on the first fruit only, internode and divergence on the others."""
    first = F.col("fruit_id") == 1
    shown = {"plant_id": first, "orientation": first, "internode": ~first, "div_angle": ~first}
    own = [(F.when(shown[c], F.col(c)) if c in shown else F.col(c)).alias(name) for name, c in CSV.items()]
    return fruits.select(F.col("plant_id").alias("key_plant"), F.col("fruit_id").cast("long").alias("key_fruit"), *own)


def write_csv(fruits: DataFrame, path: str) -> None:
    """A range-partitioned global sort, then part files in order."""
    export_rows(fruits).orderBy("key_plant", "key_fruit").drop("key_plant", "key_fruit").write.csv(path, header=True)


def measurements(fruits: DataFrame) -> DataFrame:
    """One row a plant: plant_id, orientation, and arrays of the fruits' values by rank; internodes and div_angles from the second fruit on."""
    own = F.array_sort(F.collect_list(F.struct("fruit_id", *VALUES, "internode", "div_angle")))
    rest = lambda c: F.transform(F.filter("f", lambda x: x["fruit_id"] > 1), lambda x: x[c])
    rows = fruits.groupBy("plant_id").agg(F.first("orientation").alias("orientation"), own.alias("f"))
    return rows.select("plant_id", "orientation", *(F.col("f")[c].alias(f"{c}s" if c == "length" else c) for c in VALUES), rest("internode").alias("internodes"), rest("div_angle").alias("div_angles"))


def json_rows(fruits: DataFrame) -> DataFrame:
    """plant_id, measurement: each plant's arrays as JSON text."""
    rows = measurements(fruits)
    return rows.select("plant_id", F.to_json(F.struct(*(c for c in rows.columns if c != "plant_id"))).alias("measurement"))


def write_json(fruits: DataFrame, path: str) -> None:
    measurements(fruits).write.json(path)


def load_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Saved results of this schema; none where nothing has been saved there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_results(new: DataFrame, old: DataFrame, path: str, guard: str | None = None) -> DataFrame:
    """Writes old with the rows of new in place of those of the same plant to a new path; the rejected rows where `guard` names a protecting column."""
    good, bad = (upsert(old, new, ["plant_id"]), new.limit(0)) if guard is None else guarded_upsert(old, new, ["plant_id"], guard)
    good.write.parquet(path)
    return bad


def pose_lines(cnc: DataFrame) -> DataFrame:
    """plant_id, frame_idx, value: `image x y z` of each pose(plant_id, frame_idx, img_name, x, y, z)."""
    return cnc.select("plant_id", "frame_idx", F.concat_ws(" ", "img_name", *(F.col(c).cast("double").cast("string") for c in "xyz")).alias("value"))


def write_poses(cnc: DataFrame, path: str) -> None:
    """A folder of text a plant, lines by frame."""
    pose_lines(cnc).repartition("plant_id").sortWithinPartitions("plant_id", "frame_idx").select("plant_id", "value").write.partitionBy("plant_id").text(path)


def to_plain(rows: DataFrame, keys: list[str], version: int = 1) -> DataFrame:
    """keys, format, version, body: rows as JSON text."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.lit("plantmill").alias("format"), F.lit(version).alias("version"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("body"))


def from_plain(plain: DataFrame, keys: list[str], schema: T.StructType, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """The rows of `to_plain` in a target schema, missing fields from defaults; and a report (keys, dropped, error).

    Unknown fields are dropped and listed; a missing field without a default is an error and its row is not returned.
    """
    read = plain.withColumn("_r", F.from_json("body", schema)).withColumn("_n", F.json_object_keys("body"))
    known = F.array(*(F.lit(f.name) for f in schema))
    need = [f.name for f in schema if f.name not in defaults]
    absent = F.array_except(F.array(*(F.lit(n) for n in need)).cast("array<string>"), "_n")
    read = read.withColumn("dropped", F.array_except("_n", known)).withColumn("missing", absent)
    good = read.where(F.size("missing") == 0)
    value = lambda f: F.when(F.array_contains("_n", f.name), F.col("_r")[f.name]).otherwise(F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name)
    report = read.where((F.size("dropped") > 0) | (F.size("missing") > 0)).select(*keys, "dropped", "missing")
    return good.select(*keys, *(value(f) for f in schema)), report


def round_trip_differences(rows: DataFrame, keys: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows that a dump and a restore in `schema` (default: their own) would lose, and those that would appear instead; none for a faithful one."""
    schema = schema or T.StructType([f for f in rows.schema if f.name not in keys])
    back, _ = from_plain(to_plain(rows, keys), keys, schema, {})
    back = back.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema))
    return rows.exceptAll(back).unionByName(back.exceptAll(rows))


def binarise_counts(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """plant_id, i, j, k of external voxel counts: n >= 1 for carving, else n >= min(threshold, the plant's largest n).

    meta(plant_id, method, threshold); the maximum is a small table of its own, so no plant is gathered.
    """
    most = counts.groupBy("plant_id").agg(F.max("n").alias("most")).join(meta, "plant_id")
    least = F.when(F.col("method") == "carving", F.lit(1)).otherwise(F.least("threshold", "most"))
    return counts.join(most.select("plant_id", least.alias("least")), "plant_id").where(F.col("n") >= F.col("least")).select("plant_id", "i", "j", "k")
