"""Occupancy votes, log-odds and their smoothing, keyed by plant_id, i, j, k."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.functions.vec import cross3, dot3
from plantmill.operators.components import cut, neighbours

VOXEL = ["plant_id", "i", "j", "k"]
AXES = ["i", "j", "k"]
BUCKET, SLAB, BRICK, HALO = 32_768, 1 << 20, 64, 20


@dataclass(frozen=True)
class VoteParams:
    # Prior and rates of the sensor model.
    prior: float = 0.05
    tpr: float = 0.95
    fpr: float = 0.1


def mask_bitmaps(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """plant_id, bitmaps array<struct<frame_idx, bucket, bits>>: each frame's mask as bitmaps of 32,768 pixels, row by row."""
    place = (F.col("row") - 1) * F.col("width") + F.col("col") - 1
    placed = mask.join(frames.select("plant_id", "frame_idx", "width"), ["plant_id", "frame_idx"]).select("plant_id", "frame_idx", place.cast("long").alias("at"))
    bits = placed.groupBy("plant_id", "frame_idx", F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((F.col("at") % BUCKET).cast("long")).alias("bits"))
    return bits.groupBy("plant_id").agg(F.collect_list(F.struct("frame_idx", "bucket", "bits")).alias("bitmaps"))


LENS = ("width", "height", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")
POSE = ("r11", "r12", "r13", "r21", "r22", "r23", "r31", "r32", "r33", "t1", "t2", "t3")


def _votes(x: np.ndarray, y: np.ndarray, z: float, frames: list, bits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For one slice of voxel centres: the frames that see each, and those whose pixel is masked."""
    seen, hits = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for f in frames:
        d = f["r31"] * x + f["r32"] * y + f["r33"] * z + f["t3"]
        a = (f["r11"] * x + f["r12"] * y + f["r13"] * z + f["t1"]) / d
        b = (f["r21"] * x + f["r22"] * y + f["r23"] * z + f["t2"]) / d
        r2 = a * a + b * b
        radial = 1 + f["k1"] * r2 + f["k2"] * r2 * r2
        u = f["fx"] * (a * radial + 2 * f["p1"] * a * b + f["p2"] * (r2 + 2 * a * a)) + f["cx"]
        v = f["fy"] * (b * radial + f["p1"] * (r2 + 2 * b * b) + 2 * f["p2"] * a * b) + f["cy"]
        inside = np.flatnonzero((d > 0) & (u >= 0) & (u < f["width"]) & (v >= 0) & (v < f["height"]))
        seen[inside] += 1
        own = bits.get(f["frame_idx"])
        if own is not None:
            at = np.floor(v[inside]).astype(np.int64) * f["width"] + np.floor(u[inside]).astype(np.int64)
            hits[inside] += (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return seen, hits


def vote_counts(grids: DataFrame, frames: DataFrame, mask: DataFrame, slab: int = SLAB) -> DataFrame:
    """plant_id, i, j, k, seen, hits: frames that see a voxel of grids(plant_id, origin, widths, voxel_size), and those where its pixel is masked.

    A grid falls into slabs of about `slab` voxels, dealt over the shuffle partitions; a slab's row carries its plant's
    frames and their masks as bitmaps (1 Mpx is 128 KB), so no projection leaves its task: a voxel moves as two counts.
    Voxels that no frame sees have zeros.
    """
    parts = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = {a: (F.floor(F.col(w) / F.col("voxel_size")) + 1).cast("long") for a, w in zip(AXES, ("wx", "wy", "wz"), strict=True)}
    slices = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(slab) / (n["i"] * n["j"])))
    slabs = grids.select("plant_id", "ox", "oy", "oz", "voxel_size", n["i"].alias("ni"), n["j"].alias("nj"), n["k"].alias("nk"), slices.alias("thick"))
    slabs = slabs.withColumn("k0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nk") - 1, F.col("thick"))))
    seen = frames.groupBy("plant_id").agg(F.collect_list(F.struct("frame_idx", *POSE, *LENS)).alias("frames"))
    rows = slabs.join(seen, "plant_id", "left").join(mask_bitmaps(mask, frames), "plant_id", "left").repartition(parts, "plant_id", "k0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = [] if row.frames is None else list(row.frames)
                bits: dict[int, np.ndarray] = {}
                size = {f["frame_idx"]: f["width"] * f["height"] for f in own}
                for m in [] if row.bitmaps is None else row.bitmaps:
                    whole = bits.setdefault(m["frame_idx"], np.zeros(-(-size[m["frame_idx"]] // BUCKET) * BUCKET // 8, np.uint8))
                    whole[m["bucket"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(m["bits"], np.uint8)
                i, j = (a.ravel() for a in np.meshgrid(np.arange(row.ni), np.arange(row.nj), indexing="ij"))
                x, y = row.ox + (i + 0.5) * row.voxel_size, row.oy + (j + 0.5) * row.voxel_size
                for k in range(row.k0, min(row.k0 + row.thick, row.nk)):
                    with np.errstate(all="ignore"):
                        seen, hits = _votes(x, y, row.oz + (k + 0.5) * row.voxel_size, own, bits)
                    yield pd.DataFrame({"plant_id": row.plant_id, "i": i, "j": j, "k": k, "seen": seen, "hits": hits})

    kind = grids.schema["plant_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"plant_id {kind}, i long, j long, k long, seen long, hits long")


def log_odds(counts: DataFrame, params: VoteParams = VoteParams()) -> DataFrame:
    """plant_id, i, j, k, lod: the prior's log-odds, plus one constant for each hit and one for each miss."""
    p = params
    hit, miss = math.log(p.tpr / p.fpr), math.log((1 - p.tpr) / (1 - p.fpr))
    lod = F.lit(math.log(p.prior / (1 - p.prior))) + F.col("hits") * hit + (F.col("seen") - F.col("hits")) * miss
    return counts.select(*VOXEL, lod.alias("lod"))


def bounds(frames: DataFrame, params: VoteParams = VoteParams()) -> DataFrame:
    """plant_id, frames, low, high: the log-odds that all misses and all hits of a voxel seen by every frame would give."""
    p = params
    n, start = F.count(F.lit(1)), math.log(p.prior / (1 - p.prior))
    return frames.groupBy("plant_id").agg(n.alias("frames"), (start + n * math.log((1 - p.tpr) / (1 - p.fpr))).alias("low"), (start + n * math.log(p.tpr / p.fpr)).alias("high"))


def probability(lod: Column) -> Column:
    return 1 / (1 + F.exp(-lod))


def occupied(lod: DataFrame, t: float, column: str = "lod") -> DataFrame:
    return lod.where(F.col(column) > t).select(*VOXEL)


def gmrf_edges(lod: DataFrame, tau: float) -> DataFrame:
    """plant_id, u, v, w both ways: face neighbours with weight exp(-((difference of log-odds) / tau)^2)."""
    met = neighbours(lod, ["plant_id"], AXES, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], ["lod"])
    u, v = F.struct(*AXES), F.struct(*(F.col(f"n_{a}").alias(a) for a in AXES))
    w = F.exp(-F.pow((F.col("lod") - F.col("n_lod")) / tau, 2))
    one = met.select("plant_id", u.alias("u"), v.alias("v"), w.alias("w"))
    return one.union(one.select("plant_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def laplacian(edges: DataFrame, x: DataFrame, column: str = "x") -> DataFrame:
    """plant_id, u, lx for x(plant_id, u, x): the sum over neighbours of w * (x_u - x_v)."""
    there = x.select("plant_id", F.col("u").alias("v"), F.col(column).alias("_xv"))
    sums = edges.join(there, ["plant_id", "v"]).groupBy("plant_id", "u").agg(F.sum("w").alias("_d"), F.sum(F.col("w") * F.col("_xv")).alias("_s"))
    return x.join(sums, ["plant_id", "u"], "left").select("plant_id", "u", F.coalesce(F.col("_d") * F.col(column) - F.col("_s"), F.lit(0.0)).alias("lx"))


def _steps(lam: float, tol: float) -> list[tuple[float, float]]:
    """The factors of the old and the new direction in each Chebyshev step for 1 + lam * L, until the error is below tol times the first.

    Weights are at most 1 and a voxel has at most six, so all eigenvalues lie between 1 and 1 + 12 * lam.
    """
    centre, half = 1 + 6 * lam, 6 * lam
    root = math.sqrt(1 + 12 * lam)
    n = math.ceil(math.log(2 / tol) / -math.log((root - 1) / (root + 1)))
    out, rho = [(0.0, 1 / centre)], half / centre
    for _ in range(n - 1):
        nxt = 1 / (2 * centre / half - rho)
        out.append((rho * nxt, 2 * nxt / half))
        rho = nxt
    return out


def _stencil(b: np.ndarray, x: np.ndarray, p: np.ndarray, tau: float, lam: float, steps: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """x and its direction after some steps on one dense block; NaN in b marks cells that do not exist."""
    absent = np.isnan(b)
    weights = []
    for axis in range(3):
        w = np.exp(-(np.diff(b, axis=axis) / tau) ** 2)
        weights.append(np.nan_to_num(w, nan=0.0))
    b, x, p = (np.where(absent, 0.0, a) for a in (b, x, p))
    for old, new in steps:
        r = b - x
        for axis, w in enumerate(weights):
            flow = lam * w * np.diff(x, axis=axis)
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(None, -1), slice(1, None)
            r[tuple(low)] += flow
            r[tuple(high)] -= flow
        p = old * p + new * r
        x = x + p
    return x, p


def smooth(lod: DataFrame, tau: float = 10.0, lam: float = 0.0, tol: float = 1e-9, brick: int = BRICK, halo: int = HALO) -> DataFrame:
    """plant_id, i, j, k, lod, smoothed: the solution of (1 + lam * L) x = lod, L the Laplacian of `gmrf_edges`.

    With lam = 0 the result is lod. Chebyshev's iteration has fixed factors, so no sum over a plant is needed and the number
    of steps follows from lam and tol: the error ends below tol times the first one. Voxels are dealt by bricks with a halo of
    as many cells as a round has steps; within it a brick needs no other, so a round is one shuffle by brick. A plant of
    any size is many bricks.
    """
    if lam == 0:
        return lod.select(*VOXEL, "lod", F.col("lod").alias("smoothed"))
    steps = _steps(lam, tol)
    state = lod.select(*VOXEL, F.col("lod").cast("double").alias("lod"), F.col("lod").cast("double").alias("x"), F.lit(0.0).alias("p"))
    rounds = -(-len(steps) // halo)
    size = -(-len(steps) // rounds)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)

    def sweep(own_steps: list[tuple[float, float]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            at = [rows[a].to_numpy() for a in AXES]
            first = [int(a.min()) for a in at]
            place = tuple(a - f for a, f in zip(at, first, strict=True))
            own = np.logical_and.reduce([a // brick == rows[f"_{n}"].iloc[0] for a, n in zip(at, AXES, strict=True)])
            block = [np.full([int(a.max()) + 1 for a in place], np.nan) for _ in range(3)]
            for whole, c in zip(block, ("lod", "x", "p"), strict=True):
                whole[place] = rows[c]
            x, p = _stencil(*block, tau, lam, own_steps)
            mine = tuple(a[own] for a in place)
            return rows.loc[own, [*VOXEL, "lod"]].assign(x=x[mine], p=p[mine])

        return run

    for k in range(rounds):
        now = steps[k * size : (k + 1) * size]
        spread = state
        for a in AXES:
            spread = spread.withColumn(f"_{a}", F.explode(F.sequence(F.floor((F.col(a) - len(now)) / brick), F.floor((F.col(a) + len(now)) / brick))))
        state = cut(spread.groupBy("plant_id", *(f"_{a}" for a in AXES)).applyInPandas(sweep(now), kinds))
    return state.select(*VOXEL, "lod", F.col("x").alias("smoothed"))


def voxel_counts(lod: DataFrame, t: float) -> DataFrame:
    """plant_id, voxels, occupied, max_lod."""
    return lod.groupBy("plant_id").agg(F.count(F.lit(1)).alias("voxels"), F.count(F.when(F.col("lod") > t, 1)).alias("occupied"), F.max("lod").alias("max_lod"))


# The six tetrahedra of a cube: the ways from corner 000 to 111 along the axes in each order. A corner is i + 2 j + 4 k.
TETRAHEDRA = [(0, a, a + b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


def isosurface(volume: DataFrame, grids: DataFrame, t: float, column: str = "lod") -> tuple[DataFrame, DataFrame]:
    """The surface where a volume crosses t, as vertices(plant_id, a, b, x, y, z) and triangles(plant_id, i, j, k, tetrahedron, triangle, corners).

    Each cube of eight voxels falls into six tetrahedra, so that the triangles follow from the number of corners above t, without
    a table of cases. A vertex lies on the edge from voxel a to voxel b (structs of i, j, k; a comes first), at the linear
    crossing; a triangle's corners are three such edges, turned so that its front faces the lower side. Only cubes that
    a voxel above t touches are looked at, and a vertex that triangles share is one row.
    """
    cell = lambda s: [(F.col(a) + F.col(f"_o.{a}") * s).alias(a) for a in AXES]
    offsets = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(n >> k & 1).cast("long").alias(a) for k, a in enumerate(AXES))) for n in range(8))))
    values = volume.select(*VOXEL, F.col(column).cast("double").alias("v"))
    cells = values.where(F.col("v") > t).select(*VOXEL, offsets.alias("_o")).select("plant_id", *cell(-1)).distinct()
    corners = cells.select(*VOXEL, offsets.alias("_o")).select("plant_id", *(F.col(a).alias(f"c{a}") for a in AXES), F.col("_o.n").alias("n"), *cell(1))
    met = corners.join(values, VOXEL).groupBy("plant_id", *(f"c{a}" for a in AXES)).agg(F.array_sort(F.collect_list(F.struct("n", *AXES, "v"))).alias("c"), F.min("v").alias("low"))
    met = met.where((F.size("c") == 8) & (F.col("low") <= t))
    tets = met.select("plant_id", *(f"c{a}" for a in AXES), F.posexplode(F.array(*(F.array(*(F.get("c", F.lit(n)) for n in tet)) for tet in TETRAHEDRA))).alias("tetrahedron", "p"))
    tets = tets.withColumn("up", F.filter("p", lambda x: x["v"] > t)).withColumn("down", F.filter("p", lambda x: x["v"] <= t))
    place = lambda x: F.struct(*(x[a].alias(a) for a in AXES), x["v"].alias("v"))
    edge = lambda u, d: F.struct(F.least(place(u), place(d)).alias("a"), F.greatest(place(u), place(d)).alias("b"))
    u, d = (lambda k: F.get("up", F.lit(k))), (lambda k: F.get("down", F.lit(k)))
    one = F.array(F.array(edge(u(0), d(0)), edge(u(0), d(1)), edge(u(0), d(2))))
    three = F.array(F.array(edge(u(0), d(0)), edge(u(1), d(0)), edge(u(2), d(0))))
    two = F.array(F.array(edge(u(0), d(0)), edge(u(0), d(1)), edge(u(1), d(1))), F.array(edge(u(0), d(0)), edge(u(1), d(1)), edge(u(1), d(0))))
    n = F.size("up")
    shaped = F.when(n == 1, one).when(n == 3, three).when(n == 2, two)
    flat = tets.where((n > 0) & (n < 4)).select("plant_id", *(f"c{a}" for a in AXES), "tetrahedron", "up", "down", F.posexplode(shaped).alias("triangle", "e"))
    # The front: the normal against the way from the mean of the corners above t to that of those below.
    part = lambda e: F.try_divide(t - e["a"]["v"], e["b"]["v"] - e["a"]["v"])
    at = lambda e: [e["a"][a] + part(e) * (e["b"][a] - e["a"][a]) for a in AXES]
    mean = lambda side, a: F.aggregate(side, F.lit(0.0), lambda s, x: s + x[a]) / F.size(side)
    p0, p1, p2 = (at(F.get("e", F.lit(k))) for k in range(3))
    normal = cross3([x - y for x, y in zip(p1, p0, strict=True)], [x - y for x, y in zip(p2, p0, strict=True)])
    front = dot3(normal, [mean("down", a) - mean("up", a) for a in AXES])
    key = lambda e: F.struct(*(F.struct(*(e[s][a].alias(a) for a in AXES)).alias(s) for s in "ab"))
    g = [F.get("e", F.lit(k)) for k in range(3)]
    turned = F.when(front < 0, F.array(key(g[0]), key(g[2]), key(g[1]))).otherwise(F.array(*map(key, g)))
    triangles = flat.select("plant_id", *(F.col(f"c{a}").alias(a) for a in AXES), "tetrahedron", "triangle", turned.alias("corners"))
    points = flat.select("plant_id", F.explode("e").alias("e")).distinct()
    own = grids.select("plant_id", "ox", "oy", "oz", "voxel_size")
    e = F.col("e")
    centre = [(F.col(o) + (x + 0.5) * F.col("voxel_size")).alias(c) for o, x, c in zip(("ox", "oy", "oz"), at(e), "xyz", strict=True)]
    vertices = points.join(own, "plant_id").select("plant_id", key(e)["a"].alias("a"), key(e)["b"].alias("b"), *centre)
    return vertices, triangles
