"""Connected components of cells and graphs: runs of cells, and rounds of joins over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRICK = 16  # cells of a brick's side


def whole_unions(spark: SparkSession) -> None:
    """Spark 4.1 lets a union keep its sides' partitioning; where adaptive execution has given the sides unlike numbers of partitions, rows are lost. This turns that off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; one of its own only where none is set and driver and executors are one process."""
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
    """`df` written to the shared folder as a table: later steps neither compute it again nor depend on one executor.

    Not checkpoint(): its rows keep the size estimates of the plan that made them. Each join multiplies estimates, so after
    some rounds they have thousands of digits and planning takes seconds; a table has the size of its files, by which Spark
    also finds the sides that it may broadcast.
    """
    whole_unions(df.sparkSession)
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The bounds of each list, and the lists' structs end to end, a NumPy array for each field."""
    rows = column.flatten()
    return column.offsets.to_numpy() - column.offsets[0].as_py(), {f.name: rows.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(rows.type)}


def in_bricks(cells: DataFrame, keys: list[str], axes: list[str], reach: Column | int = 0) -> DataFrame:
    """cells with _b_<axis>, the bricks of BRICK cells a side that lie within `reach` of them along each axis: a row for each brick."""
    out = cells.where(" and ".join(f"{a} is not null" for a in [*keys, *axes]))
    for a in axes:
        out = out.withColumn(f"_b_{a}", F.explode(F.sequence(F.floor((F.col(a) - reach) / BRICK), F.floor((F.col(a) + reach) / BRICK))))
    return out


def neighbours(cells: DataFrame, keys: list[str], axes: list[str], offsets: list[tuple[int, ...]], carry: list[str] = ()) -> DataFrame:
    """Cells joined to those at the offsets (each -1, 0 or 1): keys, axes, the neighbour's axes as n_<axis>, and `carry` of both (n_<column>).

    A brick with the cells around it is one row, so a cell goes to its own brick and to those that it borders, not once to each
    offset, and the pairs are made in the task.
    """
    names, bricks = [*axes, *carry], [f"_b_{a}" for a in axes]
    kinds = dict(cells.dtypes)
    packed = in_bricks(cells.select(*keys, *names), keys, axes, 1).groupBy(*keys, *bricks).agg(F.collect_list(F.struct(*names)).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, own), rows = flat(batch.column("_c")), batch.column("_c").flatten()
            low = [batch.column(b).to_numpy() * BRICK - 1 for b in bricks]
            for k in range(batch.num_rows):
                here = [own[a][ends[k] : ends[k + 1]].astype(np.int64) - at[k] for a, at in zip(axes, low, strict=True)]
                weight = [(BRICK + 2) ** n for n in range(len(axes))]
                code = sum(h * w for h, w in zip(here, weight, strict=True))
                order = np.argsort(code, kind="stable")
                ranked = code[order]
                inner = np.flatnonzero(np.all([(h > 0) & (h <= BRICK) for h in here], axis=0))
                one, two = [], []
                for o in offsets:
                    want = code[inner] + sum(x * w for x, w in zip(o, weight, strict=True))
                    first = np.searchsorted(ranked, want)
                    n = np.searchsorted(ranked, want, "right") - first
                    one.append(np.repeat(inner, n))
                    two.append(order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
                one, two = (pa.array(np.concatenate(x) + ends[k]) for x in (one, two))
                if len(one):
                    at = pa.array(np.full(len(one), k))
                    a, b = rows.take(one), rows.take(two)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(x.field(n) for x in (a, b) for n in range(len(names)))], [*keys, *names, *(f"n_{c}" for c in names)])

    schema = ", ".join(f"`{c}` {kinds[x]}" for c, x in [*((c, c) for c in [*keys, *names]), *((f"n_{c}", c) for c in names)])
    return packed.mapInArrow(run, schema).select(*keys, *axes, *carry, *(f"n_{c}" for c in names))


def face_offsets(n: int) -> list[tuple[int, ...]]:
    return [tuple(s * (k == a) for k in range(n)) for a in range(n) for s in (1, -1)]


def labels(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label (the smallest node that links reach) for nodes(node) and edges(u, v).

    A round hangs each node's larger neighbours on its smallest one, then each node's smaller neighbours on the smallest of
    them; ways to a root halve, so rounds grow with the logarithm of the longest way, and `most` is only reached by an error.
    Joins and grouped minima alone: one node's neighbours are never in one task. The driver sees one flag a round.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most):
        near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u")
        links = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        above = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        unsettled = above.join(above.select(F.col("u").alias("v")), "v", "left_semi").union(above.where("n > 1").select("v", "u", "n"))
        if unsettled.isEmpty():  # every node hangs on one root
            return nodes.select("node").distinct().join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
    raise RuntimeError("components have not settled")


def cell_runs(cells: DataFrame, keys: list[str], axes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells as runs of consecutive cells along the last axis: cells with their run's number `_run` in its line, and the runs (keys, other axes, _run, lo, hi, node)."""
    along, across = axes[-1], [*keys, *axes[:-1]]
    line = Window.partitionBy(*across).orderBy(along)
    begins = F.when(F.lag(along).over(line) == F.col(along) - 1, 0).otherwise(1)
    placed = cells.select(*keys, *axes).distinct().withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(line)).drop("_begins")
    runs = placed.groupBy(*across, "_run").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    return placed, cut(runs.withColumn("node", F.monotonically_increasing_id()))


def cell_components(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """cells with `label`: face-connected components; a label is the first cell of its component, as a struct of axes.

    Runs of cells are the nodes, and runs that touch in neighbouring lines the edges, so a thick plant has far fewer nodes
    than voxels, and single cells only meet their own line's runs. Null axes are no cells' places; equal cells are one cell.
    """
    along, across = axes[-1], [*keys, *axes[:-1]]
    placed, runs = cell_runs(cells, keys, axes)
    steps = F.array(*(F.struct(*(F.lit(int(a == b)).alias(b) for b in axes[:-1])) for a in axes[:-1]))
    moved = runs.withColumn("_o", F.explode(steps)).select(*keys, *((F.col(a) + F.col("_o")[a]).alias(a) for a in axes[:-1]), F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("node").alias("v"))
    touching = runs.join(moved, across).where("lo <= b AND hi >= a")
    found = labels(runs.select("node"), touching.select(F.col("node").alias("u"), "v"))
    named = runs.join(found, "node").select(*across, "_run", F.col("label").alias("_root"), F.col("lo").alias(along))
    first = named.groupBy("_root").agg(F.min(F.struct(*axes)).alias("label"))
    return placed.join(named.drop(along).join(first, "_root").drop("_root"), [*across, "_run"]).select(*keys, *axes, "label")


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))


def remove_small(cells: DataFrame, keys: list[str], axes: list[str], least: int) -> DataFrame:
    """The cells of components of at least `least` cells."""
    if least <= 1:
        return cells.select(*keys, *axes)
    found = cell_components(cells, keys, axes)
    big = component_sizes(found, keys).where(F.col("size") >= least)
    return found.join(big, [*keys, "label"], "left_semi").select(*keys, *axes)


def keep_largest(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """The cells of each group's largest component; of equals the one with the first label."""
    found = cell_components(cells, keys, axes)
    best = component_sizes(found, keys).groupBy(*keys).agg(F.min(F.struct((-F.col("size")).alias("s"), "label")).alias("b")).select(*keys, F.col("b.label").alias("label"))
    return found.join(best, [*keys, "label"], "left_semi").select(*keys, *axes)
