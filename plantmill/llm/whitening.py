"""Embedding whitening by Spark's own distributed singular value decomposition.

Entries become whole numbers x, so sums and deviations are exact. The rows, centred as (n * x - S) / n before anything is
multiplied, make a RowMatrix; the right singular vectors of its computeSVD are the components, and a singular value s gives
the eigenvalue s^2 / n of the covariance with divisor n. The total variance is not the sum of those eigenvalues (only the
leading ones are asked for) but comes from the exact deviations, which are added up as decimals.

No pass shuffles rows: sums, products of whitened rows and deviations are added up per task first. The driver holds the
components (dimensions times `COMPONENTS`) and, inside computeSVD, one matrix of dimensions by dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmill.llm.common import cut, summed

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
# Smaller singular values than this share of the largest are rounding of a matrix of lower rank.
RANK = 1e-6
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # a column for each component
    values: np.ndarray

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, whole, and the whitened rows."""
        if x.size and float(np.abs(x).max()) * self.n * 2 > 2**62:
            raise OverflowError("n * x does not fit a long")
        apart = self.n * x - np.array(self.sums, np.int64)
        return apart, (apart / self.n) @ (self.vectors / np.sqrt(self.values))


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<bigint> of the rows to fit.

    Null vectors and those with null or non-finite entries are dropped, and so are those of another length than most (of
    equally frequent lengths the longest counts) and empty ones: they have no place in one covariance.
    """
    c = F.col("embedding")
    good = vectors.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).select("vec_id", "embedding")
    most = good.groupBy(F.size("embedding").alias("k")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("k")).first()
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return good.where(F.size("embedding") == (most["k"] if most else 0)).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            total = total + np.append(_matrix(b).sum(0), b.num_rows) if b.num_rows else total
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["v"])

    found = summed(rows.mapInArrow(run, "v array<bigint>"), []).get((), np.zeros(1, np.int64))
    return int(found[-1]), [int(s) for s in found[:-1]]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of `whole` rows by falling eigenvalue; None if no row differs from another.

    Of equal eigenvalues any order may result. Components beyond the rank of the rows do not exist and are left out.
    """
    n, sums = exact_sums(rows)
    if n < 2 or rows.where(F.col("x") != F.lit([s // n for s in sums]).cast("array<bigint>")).isEmpty():
        return None
    d = len(sums)
    centred = F.transform("x", lambda v, i: (v * n - F.get(F.lit(sums).cast("array<bigint>"), i)) / n)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v"), numCols=d)
    # Asking for over half of the dimensions makes Spark decompose the whole product matrix, to full precision.
    found = matrix.computeSVD(min(d, max(components, d // 2 + 1)), computeU=False, rCond=RANK)
    s = found.s.toArray()[:components]
    return Whitening(n, sums, found.V.toArray()[:, : len(s)], np.square(s) / n)


def checks(rows: DataFrame, model: Whitening) -> tuple[float, float]:
    """The total variance, and the largest entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, deviation = np.zeros(k + k * k), 0
        for b in batches:
            apart, y = model.rows(_matrix(b))
            total += np.concatenate([y.sum(0), (y.T @ y).ravel()])
            deviation += sum(int(v) for v in _squares(apart))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([str(deviation)])], ["v", "deviation"])

    parts = cut(rows.mapInArrow(run, "v array<double>, deviation string"))
    total, deviation = summed(parts, [])[()], parts.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]
    mean = total[:k] / model.n  # of centred rows: rounding alone
    covariance = total[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(int(deviation) / model.n**3), float(np.abs(covariance - np.eye(k)).max())


def _squares(apart: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row."""
    if apart.size and math.sqrt(apart.shape[1]) * float(np.abs(apart).max()) >= 2**31.4:
        raise OverflowError("a deviation does not fit a long")
    return np.square(apart).sum(1)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each fitted row and component.

    Which rows are fitted says `whole`; components and ties, `fit`. Repeated rows count, and are returned, each; a null
    vec_id is kept. Without two different rows there is no component, so no row; the same for an empty table. Other columns
    are ignored, also those named like columns of the result. Entries so large that a deviation does not fit a long are an
    error, never a wrong figure.
    """
    rows = whole(vectors)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    variance, error = checks(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart, y = model.rows(_matrix(b))
            columns = [b.column("vec_id"), pa.array(_squares(apart), pa.int64()), pa.array(y.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "y"])

    done = rows.mapInArrow(run, "vec_id long, deviation long, y array<double>").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    explained = F.get(F.lit([float(v) for v in model.values / variance]), F.col("at"))
    return done.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
