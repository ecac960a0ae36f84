"""Image operators on long pixel tables, keyed by plant_id, frame_idx, row, col. Masks hold true pixels only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.operators import components

KEYS = ["plant_id", "frame_idx"]
PIXEL = [*KEYS, "row", "col"]
TILE = 256


def _index(pixels: DataFrame, value: Column, least: float) -> DataFrame:
    total = F.col("r") + F.col("g") + F.col("b")
    return pixels.select(*PIXEL, F.when((total >= least) & (total > 0), value / total).otherwise(0.0).alias("feat"))


def green_index(pixels: DataFrame, least: float = 127 / 255) -> DataFrame:
    """The green share of each pixel; 0 where r + g + b is below `least`."""
    return _index(pixels, F.col("g"), least)


def red_index(pixels: DataFrame, least: float = 127 / 255) -> DataFrame:
    return _index(pixels, F.col("r") + F.col("b") / 2.4, least)


def green_minus_red_index(pixels: DataFrame, least: float = 127 / 255) -> DataFrame:
    return _index(pixels, F.col("g") + 1.4 * F.col("b") / 5.4, least)


def grey(pixels: DataFrame) -> DataFrame:
    """Luma on the grid of 1/255."""
    luma = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return pixels.select(*PIXEL, (F.round(luma * 255) / 255).alias("feat"))


def threshold(features: DataFrame, t: float) -> DataFrame:
    """The pixels whose feature is above t."""
    return features.where(F.col("feat") > t).select(*PIXEL)


def dilate(mask: DataFrame, side: int, rows: int, cols: int) -> DataFrame:
    """The mask grown by a diamond of `side` pixels across, within the image; 0 and 1 leave it as it is."""
    reach = (side - 1) // 2
    if reach < 1:
        return mask.select(*PIXEL)
    around = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if abs(a) + abs(b) <= reach]
    grown = mask.withColumn("o", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around))))
    grown = grown.select(*KEYS, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    return grown.where(F.col("row").between(1, rows) & F.col("col").between(1, cols)).distinct()


def mask(features: DataFrame, t: float, least: int, side: int, rows: int, cols: int) -> DataFrame:
    """Threshold, drop components of fewer than `least` pixels, dilate."""
    return dilate(components.remove_small(threshold(features, t), KEYS, ["row", "col"], least), side, rows, cols)


def coverage(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """plant_id, coverage: masked pixels over all pixels of the plant's frames."""
    area = frames.groupBy("plant_id").agg(F.sum(F.col("width") * F.col("height")).alias("area"))
    return mask.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")).join(area, "plant_id", "right").select("plant_id", (F.coalesce("n", F.lit(0)) / F.col("area")).alias("coverage"))


def line_element(half: int, angle: float) -> list[tuple[int, int]]:
    """Offsets (row, col) of a digital line through the origin, which is left out; it reaches `half` along its main axis.

    The ends round half to even, the points between them half away from zero.
    """
    if half == 0:
        return []
    scale = half / max(abs(math.cos(angle)), abs(math.sin(angle)))
    ends = (round(scale * math.sin(angle)), round(scale * math.cos(angle)))
    away = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
    half_line = {(away(ends[0] * k / half), away(ends[1] * k / half)) for k in range(1, half + 1)}
    return sorted(half_line | {(-a, -b) for a, b in half_line})


def box_element(half: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if (a, b) != (0, 0)]


def on_tiles(feat: DataFrame, halo: int, work: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """`work` on each image, tile by tile: it gets the pixels of a tile and of `halo` pixels around it (NaN where there is none).

    One shuffle by tile; an image of any size is many tiles, so no task holds more than one tile's pixels at a time.
    """
    spread = feat.select(*PIXEL, F.col("feat").cast("double").alias("feat"))
    for axis in ("row", "col"):
        ends = (F.floor((F.col(axis) - 1 - halo) / tile), F.floor((F.col(axis) - 1 + halo) / tile))
        spread = spread.withColumn(f"_{axis}", F.explode(F.sequence(*ends)))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        r, c = x["row"].to_numpy(), x["col"].to_numpy()
        own = (r - 1) // tile == x["_row"].iloc[0]
        own &= (c - 1) // tile == x["_col"].iloc[0]
        whole = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        whole[r - r.min(), c - c.min()] = x["feat"]
        done = work(whole)
        x = x.loc[own, PIXEL]
        return x.assign(feat=done[x["row"].to_numpy() - r.min(), x["col"].to_numpy() - c.min()])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feat.select(*PIXEL).schema)
    return spread.groupBy(*KEYS, "_row", "_col").applyInPandas(run, f"{kinds}, feat double")


def shifted(a: np.ndarray, by: tuple[int, int]) -> np.ndarray:
    """The array whose element at x is a[x + by]; NaN outside."""
    out = np.full_like(a, np.nan)
    n, m = a.shape
    dr, dc = by
    if abs(dr) < n and abs(dc) < m:
        out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[max(0, dr) : n - max(0, -dr), max(0, dc) : m - max(0, -dc)]
    return out


def opened(a: np.ndarray, around: list[tuple[int, int]]) -> np.ndarray:
    absent, low, high = np.isnan(a), a.copy(), None
    for o in around:
        np.fmin(low, shifted(a, o), out=low)
    low[absent] = np.nan
    high = low.copy()
    for dr, dc in around:
        np.fmax(high, shifted(low, (-dr, -dc)), out=high)
    high[absent] = np.nan
    return high


def _reach(around: list[tuple[int, int]]) -> int:
    return max((max(abs(a), abs(b)) for a, b in around), default=0)


def opening(feat: DataFrame, around: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """Grey erosion, then dilation, by an element of offsets and the origin; pixels outside the image are ignored."""
    return on_tiles(feat, 2 * _reach(around), lambda a: opened(a, around), tile)


def thin_lines(feat: DataFrame, half: int, tile: int = TILE) -> DataFrame:
    """The largest of the 4 * half line openings, minus the opening by a box of side 2 * half + 1."""
    turned = [line_element(half, math.pi * k / (4 * half)) for k in range(4 * half)]

    def work(a: np.ndarray) -> np.ndarray:
        best = opened(a, turned[0])
        for around in turned[1:]:
            np.fmax(best, opened(a, around), out=best)
        return best - opened(a, box_element(half))

    return on_tiles(feat, 2 * half, work, tile)


def blur(feat: DataFrame, sigma: float, tile: int = TILE) -> DataFrame:
    """Gaussian blur, rows then columns, of 4 * ceil(sigma) + 1 weights; weights outside the image are left out."""
    if sigma <= 0:
        return feat.select(*PIXEL, "feat")
    reach = 2 * math.ceil(sigma)

    def work(a: np.ndarray) -> np.ndarray:
        absent = np.isnan(a)
        for axis in (0, 1):
            total, weight = np.zeros_like(a), np.zeros_like(a)
            for k in range(-reach, reach + 1):
                w, moved = math.exp(-k * k / (2 * sigma * sigma)), shifted(a, (k, 0) if axis == 0 else (0, k))
                there = ~np.isnan(moved)
                total[there] += w * moved[there]
                weight[there] += w
            a = np.where(absent, np.nan, total / np.where(weight > 0, weight, 1.0))
        return a

    return on_tiles(feat, reach, work, tile)


@dataclass(frozen=True)
class MaskParams:
    # Lines or green index, blur, half length of a line, least brightness, threshold, least component, dilation.
    use_line: bool = True
    sigma: float = 0.0
    half: int = 2
    least: float = 127 / 255
    t: float = 15 / 255
    least_pixels: int = 0
    side: int = 3

    def feature_key(self) -> str:
        """Names the parameters that features depend on; masks of other thresholds share them."""
        return f"lines-{self.sigma}-{self.half}" if self.use_line else f"green-{self.sigma}-{self.least}"


def features(pixels: DataFrame, params: MaskParams = MaskParams()) -> DataFrame:
    """The feature of every pixel of pixels(plant_id, frame_idx, row, col, r, g, b), on the grid of 1/255: each channel blurred, then thin lines of the grey image, or the green index."""
    p, soft = params, pixels
    if p.sigma > 0:
        soft = None
        for c in "rgb":
            one = blur(pixels.select(*PIXEL, F.col(c).alias("feat")), p.sigma).withColumnRenamed("feat", c)
            soft = one if soft is None else soft.join(one, PIXEL)
    feat = thin_lines(grey(soft), p.half) if p.use_line else green_index(soft, p.least)
    return feat.withColumn("feat", F.round(F.col("feat") * 255) / 255)


def changed_features(feats: DataFrame, pixels: DataFrame, old: MaskParams, new: MaskParams) -> DataFrame:
    """The features for new parameters: `feats`, those of the old ones, unless a parameter that features depend on has changed."""
    return feats if old.feature_key() == new.feature_key() else features(pixels, new)


def frame_masks(feats: DataFrame, params: MaskParams, rows: int, cols: int) -> DataFrame:
    """The mask of every frame by the parameters that features do not depend on."""
    return mask(feats, params.t, params.least_pixels, params.side, rows, cols)
