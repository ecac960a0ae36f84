"""Shared folders, lineage cuts and column helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def whole_unions(spark: SparkSession) -> None:
    """Spark 4.1 lets a union keep its sides' partitioning, and loses rows where adaptive execution gave them unlike numbers of partitions. This turns that off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    small_batches(spark)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB where the session has Spark's own 64 MB, so that rows with long texts or sketches do not fill a worker."""
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    `spark.checkpoint.dir` names it on a cluster. Only where neither the session nor the context has one and driver and
    executors are one process (tests) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plantmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder: later jobs neither recompute it nor depend on one executor."""
    whole_unions(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    whole_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "left", ways: int = 16, wide: bool = False) -> DataFrame:
    """rows joined to side (one row a key). A key's rows are dealt over `ways` tasks by hash of `by`.

    side's row goes to all of those; where it is `wide`, only to those that have some, which takes one more shuffle of keys.
    """
    rows = rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    met = rows.select(key, "_way").distinct().join(side, key) if wide else side.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.join(met, [key, "_way"], how).drop("_way")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def raw_texts(batches: Iterator[pa.RecordBatch], key: str, rows: int = 512) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The keys and UTF-8 texts (null: empty) of Arrow batches, `rows` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(key), [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def summed(parts: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """Vectors v of rows with equal keys, added up by position. For one row a task: keys and positions alone reach the driver."""
    rows = parts.select(*keys, F.posexplode("v").alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_x")).collect()
    out: dict[tuple, dict[int, float]] = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), {})[r["_at"]] = r["_x"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}
