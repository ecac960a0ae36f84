"""Fruit measurements: ranks, internodes, winding, divergence, emergence angles and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantmill.functions.vec import angdist_deg, clamp, cross3, dot3, mod2pi, norm3, unit3, vec, wrap_pi
from plantmill.operators import curves
from plantmill.operators.components import cut


def by_fruit() -> WindowSpec:
    return Window.partitionBy("plant_id").orderBy("fruit_id")


def fruit_rank(fruits: DataFrame) -> DataFrame:
    """fruits(plant_id, node_id, arc, ...) with fruit_id: the order along the stem from the root, ties by node id."""
    return fruits.withColumn("fruit_id", F.row_number().over(Window.partitionBy("plant_id").orderBy("arc", "node_id")))


def internodes(fruits: DataFrame) -> DataFrame:
    """fruits with internode: arc length from the fruit below; null for the first."""
    return fruits.withColumn("internode", F.col("arc") - F.lag("arc").over(by_fruit()))


def chirality(fruits: DataFrame) -> DataFrame:
    """plant_id, orientation: ccw if most smallest arcs between consecutive azimuths are positive, cw if negative, else ambiguous.

    NaN azimuths vote for nothing.
    """
    arc = wrap_pi(F.lead("azimuth").over(by_fruit()) - F.col("azimuth"))
    arcs = fruits.select("plant_id", arc.alias("arc"))
    vote = lambda c: F.sum(F.when(~F.isnan("arc") & c, 1).otherwise(0))
    sums = arcs.groupBy("plant_id").agg(vote(F.col("arc") > 0).alias("up"), vote(F.col("arc") < 0).alias("down"))
    name = F.when(F.col("up") > F.col("down"), "ccw").when(F.col("up") < F.col("down"), "cw").otherwise("ambiguous")
    return sums.select("plant_id", name.alias("orientation"))


def divergence(fruits: DataFrame) -> DataFrame:
    """fruits with orientation and div_angle: degrees in [0, 360) from the fruit below, in the plant's winding direction."""
    turn = F.col("azimuth") - F.lag("azimuth").over(by_fruit())
    both = fruits.join(chirality(fruits), "plant_id")
    return both.withColumn("div_angle", F.degrees(F.when(F.col("orientation") == "cw", mod2pi(-turn)).otherwise(mod2pi(turn))))


def roll_up(fruits: DataFrame) -> DataFrame:
    """plant_id, orientation, lengths, internodes, div_angles: arrays by rank; the first fruit has no internode."""
    own = F.array_sort(F.collect_list(F.struct("fruit_id", "arc", "internode", "div_angle")))
    rest = lambda c: F.transform(F.filter("f", lambda x: x["fruit_id"] > 1), lambda x: x[c])
    return fruits.groupBy("plant_id", "orientation").agg(own.alias("f")).select("plant_id", "orientation", F.size("f").cast("long").alias("n_fruits"), F.transform("f", lambda x: x["arc"]).alias("arcs"), rest("internode").alias("internodes"), rest("div_angle").alias("div_angles"))


def polar_azimuth(directions: DataFrame) -> DataFrame:
    """directions(sx.., bx.., rx..) with theta, phi of the branch b about the stem s, against a reference r; unit vectors are made here.

    phi is in [0, 2 pi), and NaN where the branch or the reference runs along the stem.
    """
    out = directions
    for p in "sbr":
        u = unit3(vec(*(f"{p}{c}" for c in "xyz")))
        out = out.withColumns({f"_{p}{c}": x for c, x in zip("xyz", u, strict=True)})
    s, b, r = (vec(*(f"_{p}{c}" for c in "xyz")) for p in "sbr")
    c = dot3(s, b)
    x, y = dot3(b, r) - dot3(s, r) * c, dot3(b, cross3(s, r))
    across = [bk - c * sk for bk, sk in zip(b, s, strict=True)]
    # The square root of the spacing of doubles at 1.
    flat = (norm3(across) < 2.0**-26) | (F.abs(dot3(s, r)) > 1 - 2.0**-26)
    phi = F.when(flat, F.lit(float("nan"))).otherwise(mod2pi(F.atan2(y, x)))
    return out.withColumns({"theta": F.acos(clamp(c, -1.0, 1.0)), "phi": phi}).drop(*(f"_{p}{k}" for p in "sbr" for k in "xyz"))


def _perpendicular(u: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors across u, from the axis in which u is smallest (the first of equals)."""
    a = [F.abs(x) for x in u]
    pick = F.when((a[0] <= a[1]) & (a[0] <= a[2]), 0).when(a[1] <= a[2], 1).otherwise(2)
    seed = [F.when(pick == k, 1.0).otherwise(0.0) for k in range(3)]
    raw = cross3(u, seed)
    n = norm3(raw)
    first = [x / n for x in raw]
    return first, cross3(u, first)


def angle_errors(rows: DataFrame) -> DataFrame:
    """rows(unit sx.., bx.., rx.., se_s, se_b) with se_polar, se_azimuth (degrees) and cov (square degrees), by the delta method.

    The two components of each direction across itself have variance se^2 / 2.
    """
    s, b, r = (vec(*(f"{p}{c}" for c in "xyz")) for p in "sbr")
    out = rows
    for p, base in (("s", s), ("b", b)):
        for k, e in enumerate(_perpendicular(base)):
            out = out.withColumns({f"_{p}{k}{c}": x for c, x in zip("xyz", e, strict=True)})
    c = dot3(s, b)
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    x, y = dot3(b, r) - dot3(s, r) * c, dot3(b, cross3(s, r))
    jacobian = []
    for p, se in (("s", F.col("se_s")), ("b", F.col("se_b"))):
        for k in range(2):
            e = vec(*(f"_{p}{k}{a}" for a in "xyz"))
            if p == "s":
                dt, dx, dy = F.try_divide(-dot3(b, e), sine), -dot3(e, r) * c - dot3(s, r) * dot3(e, b), dot3(b, cross3(e, r))
            else:
                dt, dx, dy = F.try_divide(-dot3(s, e), sine), dot3(e, r) - dot3(s, r) * dot3(s, e), dot3(e, cross3(s, r))
            jacobian.append((dt, F.try_divide(x * dy - y * dx, x * x + y * y), se * se / 2))
    deg = 180 / 3.141592653589793
    total = lambda f: sum(f(t, p) * v for t, p, v in jacobian)
    out = out.withColumns({"se_polar": F.sqrt(total(lambda t, p: t * t)) * deg, "se_azimuth": F.sqrt(total(lambda t, p: p * p)) * deg, "cov": total(lambda t, p: t * p) * deg * deg})
    return out.drop(*(f"_{p}{k}{a}" for p in "sb" for k in "01" for a in "xyz"))


def flag_angles(rows: DataFrame) -> DataFrame:
    """rows(theta, phi, degenerate) with NaN for all of a degenerate fit, and flagged: degenerate, or no azimuth."""
    nan = F.lit(float("nan"))
    return rows.withColumns({"theta": F.when(F.col("degenerate"), nan).otherwise(F.col("theta")), "phi": F.when(F.col("degenerate"), nan).otherwise(F.col("phi")), "flagged": F.col("degenerate") | F.isnan("phi")})


def emergence_angles(rows: DataFrame) -> DataFrame:
    """rows(unit sx.., bx.., reference rx.., se_s, se_b, degenerate) with theta, phi, flagged, se_polar, se_azimuth and cov.

    A degenerate fit has NaN for all. Where no azimuth is defined the polar angle stays, with the stem's error.
    """
    nan = F.lit(float("nan"))
    out = flag_angles(polar_azimuth(angle_errors(rows)))
    lost = F.isnan("phi")
    polar = F.when(F.col("degenerate"), nan).when(lost, F.degrees("se_s")).otherwise(F.col("se_polar"))
    return out.withColumns({"se_polar": polar, "se_azimuth": F.when(lost, nan).otherwise(F.col("se_azimuth")), "cov": F.when(lost, nan).otherwise(F.col("cov"))})


def quadratic_fit(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, b0x.., b1x.., b2x.., nu, se: weighted quadratic fits of samples(keys, u, w, x, y, z) and the error of their direction.

    Normal equations from moments, solved in closed form. nu = max(sum w - trace of the leverage, 1); se is
    sqrt(2) * sqrt(RSS / (3 nu) * (inverse)[1][1]) / |b1|. The residuals are summed in a second pass, where nothing cancels.
    """
    w, u = F.col("w"), F.col("u")
    moments = [F.sum(w * F.pow(u, F.lit(k))).alias(f"m{k}") for k in range(5)]
    squares = [F.sum(w * w * F.pow(u, F.lit(k))).alias(f"q{k}") for k in range(5)]
    sides = [F.sum(w * F.pow(u, F.lit(k)) * F.col(c)).alias(f"p{k}{c}") for k in range(3) for c in "xyz"]
    g = samples.groupBy(*keys).agg(*moments, *squares, *sides)
    m = [[F.col(f"m{a + b}") for b in range(3)] for a in range(3)]
    cof = lambda a, b: m[(a + 1) % 3][(b + 1) % 3] * m[(a + 2) % 3][(b + 2) % 3] - m[(a + 1) % 3][(b + 2) % 3] * m[(a + 2) % 3][(b + 1) % 3]
    det = sum(m[0][b] * cof(0, b) for b in range(3))
    g = g.withColumns({f"i{a}{b}": cof(b, a) / det for a in range(3) for b in range(3)})
    inv = lambda a, b: F.col(f"i{a}{b}")
    coef = {f"b{a}{c}": sum(inv(a, k) * F.col(f"p{k}{c}") for k in range(3)) for a in range(3) for c in "xyz"}
    trace = sum(inv(a, b) * F.col(f"q{a + b}") for a in range(3) for b in range(3))
    g = g.withColumns(coef).select(*keys, *coef, F.greatest(F.col("m0") - trace, F.lit(1.0)).alias("nu"), F.col("i11").alias("v"))
    both = samples.join(g, keys)
    left = [F.col(c) - (F.col(f"b0{c}") + F.col(f"b1{c}") * u + F.col(f"b2{c}") * u * u) for c in "xyz"]
    rss = both.groupBy(*keys).agg(F.sum(w * sum(e * e for e in left)).alias("rss"))
    size = F.sqrt(sum(F.col(f"b1{c}") * F.col(f"b1{c}") for c in "xyz"))
    return g.join(rss, keys).select(*keys, *coef, "nu", (F.sqrt(F.lit(2.0)) * F.sqrt(F.col("rss") / (3 * F.col("nu")) * F.col("v")) / size).alias("se"))


def tangent_fit(at: DataFrame, dense: DataFrame, points: DataFrame, sigma: float, h: float, n: int = 31, k_trunc: float = 6.0) -> DataFrame:
    """at(curve_id, fit_id, s0) with tx, ty, tz, se (radians), degenerate, s_min, s_max and the coefficients b0x.. of the fit.

    A quadratic in (s - s0) / h with Gaussian weights through n points of the smoothed curve within 3 h of s0. A window
    narrower than h / 10 is degenerate: NaN.
    """
    length = dense.groupBy("curve_id").agg(F.max("s").alias("_l"))
    low, high = F.greatest(F.lit(0.0), F.col("s0") - 3 * h), F.least(F.col("_l"), F.col("s0") + 3 * h)
    own = at.select("curve_id", "fit_id", "s0").join(length, "curve_id").select("curve_id", "fit_id", "s0", low.alias("s_min"), high.alias("s_max"))
    own = cut(own.withColumn("degenerate", F.col("s_max") - F.col("s_min") < h / 10))
    asked = own.where("not degenerate").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    asked = asked.select("curve_id", "fit_id", "s0", (F.col("s_min") + (F.col("s_max") - F.col("s_min")) * F.col("_k") / (n - 1)).alias("s"))
    found = curves.evaluate(asked, dense, points, sigma, k_trunc).withColumn("u", (F.col("s") - F.col("s0")) / h)
    samples = cut(found.select("curve_id", "fit_id", "u", F.exp(-F.col("u") * F.col("u") / 2).alias("w"), "x", "y", "z"))
    fit = quadratic_fit(samples, ["curve_id", "fit_id"])
    size = norm3(vec("b1x", "b1y", "b1z"))
    nan = F.lit(float("nan"))
    out = own.join(fit, ["curve_id", "fit_id"], "left").withColumns({f"t{c}": F.coalesce(F.col(f"b1{c}") / size, nan) for c in "xyz"})
    return out.withColumns({c: F.coalesce(c, nan) for c in ("se", "nu", *(f"b{k}{c}" for k in range(3) for c in "xyz"))})


def fit_position(curves: DataFrame, offset: float, sigma: float, h: float) -> DataFrame:
    """curves(length) with s0: offset * sigma, moved back to max(length - 3h, 0)."""
    return curves.withColumn("s0", F.least(F.lit(offset * sigma), F.greatest(F.col("length") - 3 * h, F.lit(0.0))))


def accuracy(fruits: DataFrame, truth: DataFrame) -> DataFrame:
    """plant_id, mean_error, max_error: degrees between azimuths and the truth's, by fruit."""
    met = fruits.join(truth.select("plant_id", "fruit_id", F.col("azimuth").alias("true")), ["plant_id", "fruit_id"])
    err = angdist_deg(F.degrees("azimuth"), F.degrees("true"))
    return met.groupBy("plant_id").agg(F.avg(err).alias("mean_error"), F.max(err).alias("max_error"))


def polar_arcs(rows: DataFrame, length: float, n: int = 30) -> DataFrame:
    """plant_id, fruit_id, step, x, y, z: the arc from stem to branch tangent about the junction (px.., sx.., bx.., theta), n steps of equal angle.

    Rows without both tangents, and those whose tangents are within 0.001 of each other, have none.
    """
    both = rows.where(~F.isnan("theta") & (F.col("theta") > 1e-3)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part = F.col("step") / (n - 1)
    turn = lambda c: (F.sin((1 - part) * F.col("theta")) * F.col(f"s{c}") + F.sin(part * F.col("theta")) * F.col(f"b{c}")) / F.sin("theta")
    return both.select("plant_id", "fruit_id", "step", *((F.col(f"p{c}") + 0.5 * length * turn(c)).alias(c) for c in "xyz"))


def arc_samples(fruits: DataFrame, n: int) -> DataFrame:
    """plant_id, fruit_id, step, angle: the sweep from each azimuth to the next in the winding direction, n steps."""
    nxt = F.lead("azimuth").over(by_fruit())
    sweep = F.when(F.col("orientation") == "cw", -mod2pi(F.col("azimuth") - nxt)).otherwise(mod2pi(nxt - F.col("azimuth")))
    out = fruits.withColumn("_s", sweep).where("_s is not null").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return out.select("plant_id", "fruit_id", "step", (F.col("azimuth") + F.col("_s") * F.col("step") / n).alias("angle"))
