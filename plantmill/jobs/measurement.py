"""From skeletons to fruits: smoothed stems and branches, junctions, tangent fits, angles, lengths and divergence of every plant.

Curves are keyed by `curve_id` = struct(plant_id, tip); a stem has the tip 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.jobs.skeleton import Skeleton
from plantmill.operators import curves, measure
from plantmill.operators.components import cut

XYZ = curves.XYZ


@dataclass(frozen=True)
class CurveParams:
    # Smoothing of stems and branches in mm, least samples, sample step as a share of the smoothing, reach of the kernel, offset of the fruit fits.
    sigma_stem: float = 5.0
    sigma_branch: float = 1.5
    n_min: int = 100
    dt_factor: float = 0.25
    k_trunc: float = 6.0
    offset: float = 2.0


@dataclass
class Curves:
    stem_points: DataFrame  # curve_id, seq, x, y, z
    stems: DataFrame  # dense: curve_id, seq, t, s, x, y, z
    junctions: DataFrame  # plant_id, tip, arc, x, y, z on the smoothed stem
    branch_points: DataFrame
    branches: DataFrame


def _curve(tip: str) -> Column:
    return F.struct("plant_id", F.col(tip).cast("long").alias("tip")).alias("curve_id")


def placed(path: DataFrame, nodes: DataFrame, grids: DataFrame) -> DataFrame:
    """path(plant_id, ..., node_id) with x, y, z: the centres of its voxels in grids(plant_id, ox, oy, oz, voxel_size)."""
    at = nodes.select("plant_id", "node_id", "i", "j", "k").join(grids.select("plant_id", "ox", "oy", "oz", "voxel_size"), "plant_id")
    centre = [(F.col(o) + (F.col(a) + 0.5) * F.col("voxel_size")).alias(c) for o, a, c in zip(("ox", "oy", "oz"), "ijk", XYZ, strict=True)]
    return path.join(at.select("plant_id", "node_id", *centre), ["plant_id", "node_id"])


def stem_curves(sk: Skeleton, grids: DataFrame, params: CurveParams = CurveParams()) -> tuple[DataFrame, DataFrame]:
    """The points of every stem, and its dense smoothed curve."""
    points = cut(placed(sk.stem.withColumn("tip", F.lit(0)), sk.nodes, grids).select(_curve("tip"), "seq", *XYZ))
    return points, cut(curves.smooth_curves(points, params.sigma_stem, params.dt_factor, params.n_min, params.k_trunc))


def branch_curves(sk: Skeleton, grids: DataFrame, stem_points: DataFrame, stems: DataFrame, params: CurveParams = CurveParams()) -> Curves:
    """Junctions of all branches on given stem curves, and the branches' curves, which begin at them.

    A junction is the closest place of the smoothed stem to the branch's first node.
    """
    p = params
    points = cut(placed(sk.branches, sk.nodes, grids).select("plant_id", "tip", "seq", *XYZ))
    first = points.where("seq = 0").select(F.struct("plant_id", F.lit(0).cast("long").alias("tip")).alias("curve_id"), F.col("tip").alias("target_id"), *(F.col(c).alias(f"q{c}") for c in XYZ))
    feet = curves.project_points(first, stems, stem_points, p.sigma_stem, p.k_trunc)
    junctions = cut(feet.select("curve_id.plant_id", F.col("target_id").alias("tip"), F.col("s").alias("arc"), *XYZ))
    start = junctions.select("plant_id", "tip", F.lit(-1).cast("long").alias("seq"), *XYZ)
    own = points.join(junctions.select("plant_id", "tip"), ["plant_id", "tip"], "left_semi").select("plant_id", "tip", F.col("seq").cast("long").alias("seq"), *XYZ)
    branch_points = cut(start.unionByName(own).select(_curve("tip"), "seq", *XYZ))
    branches = cut(curves.smooth_curves(branch_points, p.sigma_branch, p.dt_factor, p.n_min, p.k_trunc))
    return Curves(stem_points, stems, junctions, branch_points, branches)


def smoothed(sk: Skeleton, grids: DataFrame, params: CurveParams = CurveParams()) -> Curves:
    return branch_curves(sk, grids, *stem_curves(sk, grids, params), params)


def resmoothed(sk: Skeleton, grids: DataFrame, old: Curves, before: CurveParams, after: CurveParams) -> Curves:
    """Curves and junctions for other smoothing of the same paths; a change of the branches alone keeps the stems' curves."""
    same = (before.sigma_stem, before.dt_factor, before.n_min, before.k_trunc) == (after.sigma_stem, after.dt_factor, after.n_min, after.k_trunc)
    return branch_curves(sk, grids, old.stem_points, old.stems, after) if same else smoothed(sk, grids, after)


def fits(c: Curves, voxel_size: float, params: CurveParams = CurveParams()) -> tuple[DataFrame, DataFrame]:
    """Tangent fits of all fruits: of the stem at the junction, and of the branch `offset` smoothing widths along it, moved back on short ones.

    Both are keyed by plant_id, tip.
    """
    p, h = params, 2 * voxel_size
    at = c.junctions.select(F.struct("plant_id", F.lit(0).cast("long").alias("tip")).alias("curve_id"), F.col("tip").alias("fit_id"), F.col("arc").alias("s0"))
    stem = measure.tangent_fit(at, c.stems, c.stem_points, p.sigma_stem, h, k_trunc=p.k_trunc)
    stem = cut(stem.withColumnRenamed("fit_id", "tip").select("curve_id.plant_id", "*").drop("curve_id"))
    lengths = c.branches.groupBy("curve_id").agg(F.max("s").alias("length"))
    at = measure.fit_position(lengths, p.offset, p.sigma_branch, h).select("curve_id", F.lit(0).alias("fit_id"), "s0")
    branch = measure.tangent_fit(at, c.branches, c.branch_points, p.sigma_branch, h, k_trunc=p.k_trunc)
    branch = cut(branch.drop("fit_id").select("curve_id.plant_id", "curve_id.tip", "*").drop("curve_id"))
    return stem, branch


def measured(c: Curves, voxel_size: float, params: CurveParams = CurveParams(), fitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a fruit, numbered from the root up: length, polar, azimuth, their errors and covariance, flagged, internode, divergence and winding."""
    stem, branch = fitted or fits(c, voxel_size, params)
    side = lambda rows, x: rows.select("plant_id", "tip", *(F.col(f"t{k}").alias(f"{x}{k}") for k in "xyz"), F.col("se").alias(f"se_{x}"), F.col("degenerate").alias(f"_{x}"))
    lengths = c.branches.groupBy("curve_id").agg(F.max("s").alias("length")).select("curve_id.plant_id", "curve_id.tip", "length")
    rows = c.junctions.select("plant_id", "tip", "arc").join(lengths, ["plant_id", "tip"]).join(side(stem, "s"), ["plant_id", "tip"]).join(side(branch, "b"), ["plant_id", "tip"])
    rows = rows.withColumns({"degenerate": F.col("_s") | F.col("_b"), "rx": F.lit(1.0), "ry": F.lit(0.0), "rz": F.lit(0.0)})
    angles = measure.emergence_angles(rows).withColumnsRenamed({"theta": "polar", "phi": "azimuth"})
    ranked = measure.fruit_rank(angles.select("plant_id", F.col("tip").alias("node_id"), "arc", "length", "polar", "azimuth", "se_polar", "se_azimuth", "cov", "flagged"))
    return cut(measure.divergence(measure.internodes(cut(ranked))))


def fit_geometry(c: Curves, voxel_size: float, params: CurveParams = CurveParams(), n: int = 25) -> tuple[DataFrame, DataFrame]:
    """Behind the angles: a row a fruit with junction px.., tangents sx.. and bx.., fit point fx..; and n places each of the curve x.. and of the fit qx.. over its window.

    A degenerate fit has NaN for its points.
    """
    p, h = params, 2 * voxel_size
    stem, branch = fits(c, voxel_size, params)
    nan = F.lit(float("nan"))
    steps = branch.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    at = F.when(F.col("step") < 0, F.col("s0")).otherwise(F.col("s_min") + (F.col("s_max") - F.col("s_min")) * F.col("step") / (n - 1))
    asked = steps.select(_curve("tip"), "step", at.alias("s"), "s0", "degenerate", *(f"b{k}{c}" for k in range(3) for c in XYZ))
    found = cut(curves.evaluate(asked, c.branches, c.branch_points, p.sigma_branch, p.k_trunc))
    u = (F.col("s") - F.col("s0")) / h
    shown = {x: F.when(F.col("degenerate"), nan).otherwise(F.col(x)) for x in XYZ} | {f"q{x}": F.col(f"b0{x}") + F.col(f"b1{x}") * u + F.col(f"b2{x}") * u * u for x in XYZ}
    window = found.select("curve_id.plant_id", "curve_id.tip", "step", *(e.alias(k) for k, e in shown.items()))
    point = window.where("step < 0").select("plant_id", "tip", *(F.col(x).alias(f"f{x}") for x in XYZ))
    side = lambda rows, x: rows.select("plant_id", "tip", *(F.col(f"t{k}").alias(f"{x}{k}") for k in "xyz"))
    rows = c.junctions.select("plant_id", "tip", *(F.col(x).alias(f"p{x}") for x in XYZ)).join(side(stem, "s"), ["plant_id", "tip"]).join(side(branch, "b"), ["plant_id", "tip"]).join(point, ["plant_id", "tip"])
    return rows, window.where("step >= 0")
