"""Column helpers for 3-vectors and angles. A vector is a sequence of three columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
Vec = Sequence[Column]


def dot3(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm3(a: Vec) -> Column:
    return F.sqrt(dot3(a, a))


def unit3(a: Vec) -> list[Column]:
    n = norm3(a)
    return [F.when(n > 0, x / n).otherwise(float("nan")) for x in a]


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def mod2pi(x: Column) -> Column:
    """x in [0, 2 pi); NaN stays NaN."""
    y = x - F.floor(x / TWO_PI) * TWO_PI
    return F.when(F.isnan(x), x).when(y >= TWO_PI, F.lit(0.0)).when(y < 0, F.lit(0.0)).otherwise(y)


def wrap_pi(x: Column) -> Column:
    """The smallest signed arc equal to x; exactly half a turn rounds half to even."""
    return x - TWO_PI * F.bround(x / TWO_PI)


def angdist_deg(a: Column, b: Column) -> Column:
    """The distance of two angles in degrees, 0 to 180."""
    d = a - b
    return F.abs(d - 360.0 * F.bround(d / 360.0))


def vec(*names: str) -> list[Column]:
    return [F.col(n) for n in names]
