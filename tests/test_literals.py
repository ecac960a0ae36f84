"""Known values of cameras, grids, masks, graphs, curves and angles."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plantmill.operators import camera, components, curves, graph, image, measure, results, volume

FRAME = "plant_id int, frame_idx int, r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double, t1 double, t2 double, t3 double, width int, height int, fx double, fy double, cx double, cy double, k1 double, k2 double, p1 double, p2 double"


def frame(k1=0.0):
    return (1, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 64, 48, 50.0, 50.0, 32.0, 24.0, k1, 0.0, 0.0, 0.0)


def test_projection(spark):
    frames = spark.createDataFrame([frame()], FRAME)
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0), (1, 1, 1.0, 0.0, 10.0), (1, 2, 0.0, 1.0, 10.0), (1, 3, 0.0, 0.0, -1.0), (1, 4, 100.0, 0.0, 10.0)], "plant_id int, n int, x double, y double, z double")
    assert {r.n: (r.row, r.col) for r in camera.project(points, frames).collect()} == {0: (25, 33), 1: (25, 38), 2: (30, 33)}
    far = spark.createDataFrame([(1, 0, 2.0, 1.0, 10.0)], points.schema)
    flat, bent = (camera.project(far, spark.createDataFrame([frame(k)], FRAME), to_pixel=False).first() for k in (0.0, 0.1))
    assert bent.u > flat.u and bent.v > flat.v


def test_grids(spark):
    box = spark.createDataFrame([(1, -1.0, 2.0, 0.0, 4.0, 2.0, 6.0, 0.5)], "plant_id int, ox double, oy double, oz double, wx double, wy double, wz double, voxel_size double")
    voxels = camera.voxels_from_bbox(box)
    assert voxels.agg(F.max("i"), F.max("j"), F.max("k")).first() == (8, 4, 12)
    first = voxels.where("i = 0 and j = 0 and k = 0").first()
    assert (first.x, first.y, first.z) == (-0.75, 2.25, 0.25)
    dims = spark.createDataFrame([(1, -1.0, 2.0, 0.0, 8, 4, 12, 0.5)], "plant_id int, ox double, oy double, oz double, nx int, ny int, nz int, voxel_size double")
    last = camera.voxels_from_dims(dims).orderBy(F.desc("i"), F.desc("j"), F.desc("k")).first()
    assert (last.x, last.y, last.z) == (2.75, 3.75, 5.75)


def test_boxes(spark):
    frames = spark.createDataFrame([frame()], FRAME)
    schema = "plant_id int, ox double, oy double, oz double, wx double, wy double, wz double"
    assert camera.project_boxes(spark.createDataFrame([(1, -1.0, -1.0, 10.0, 2.0, 2.0, 2.0)], schema), frames).count() == 12
    assert camera.project_boxes(spark.createDataFrame([(1, -1.0, -1.0, -12.0, 2.0, 2.0, 2.0)], schema), frames).count() == 0


def test_masks(spark):
    cells = [(r, c) for r in (0, 1) for c in (0, 1)] + [(r, c) for r in range(4, 9) for c in range(4, 9)] + [(0, 9)]
    mask = spark.createDataFrame([(1, 1, r, c) for r, c in cells], "plant_id int, frame_idx int, row int, col int")
    keys = ["plant_id", "frame_idx"]
    assert components.remove_small(mask, keys, ["row", "col"], 4).count() == 29
    assert components.keep_largest(mask, keys, ["row", "col"]).count() == 25
    pixels = spark.createDataFrame([(1, 1, 1, 1, 0.1, 0.6, 0.1), (1, 1, 1, 2, 0.5, 0.5, 0.5), (1, 1, 1, 3, 0.01, 0.02, 0.01), (1, 1, 1, 4, 0.0, 0.0, 0.0)], "plant_id int, frame_idx int, row int, col int, r double, g double, b double")
    feat = {r.col: r.feat for r in image.green_index(pixels, 0.2).collect()}
    assert feat[1] > 0.7 and feat[2] == pytest.approx(1 / 3) and feat[3] == 0 and feat[4] == 0


def test_thin_lines_keep_lines_and_drop_squares(spark):
    value = lambda r, c: 0.9 if c in (10, 11) or (20 <= r <= 35 and 22 <= c <= 37) else 0.1
    feat = spark.createDataFrame([(1, 1, r, c, value(r, c)) for r in range(1, 41) for c in range(1, 41)], "plant_id int, frame_idx int, row int, col int, feat double")
    out = {(r.row, r.col): r.feat for r in image.thin_lines(feat, 2).collect()}
    assert out[20, 10] > 0.5 and out[28, 30] < 0.05


def test_votes(spark):
    counts = spark.createDataFrame([(1, 0, 0, 0, 7, 7), (1, 1, 0, 0, 7, 0), (1, 2, 0, 0, 0, 0)], "plant_id int, i int, j int, k int, seen int, hits int")
    lod = {r.i: r.lod for r in volume.log_odds(counts).collect()}
    prior = math.log(0.05 / 0.95)
    assert lod[0] == pytest.approx(prior + 7 * math.log(9.5)) and lod[1] < lod[2] == pytest.approx(prior)


def test_smoothing(spark):
    rng = random.Random(3)
    cells = [(1, i, j, 0, rng.uniform(-3, 3)) for i in range(5) for j in range(4)]
    lod = spark.createDataFrame(cells, "plant_id int, i int, j int, k int, lod double")
    assert all(r.lod == r.smoothed for r in volume.smooth(lod, lam=0).collect())
    got = {(r.i, r.j): r.smoothed for r in volume.smooth(lod, 10.0, 2.0).collect()}
    value = {(i, j): v for _, i, j, _, v in cells}
    for (i, j), x in got.items():
        near = [p for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if p in value]
        assert x + 2.0 * sum(math.exp(-(((value[i, j] - value[p]) / 10) ** 2)) * (x - got[p]) for p in near) == pytest.approx(value[i, j], abs=1e-4)


def plant(spark, seed=5, n=6, share=0.45):
    rng = random.Random(seed)
    cells = [(p, i, j, k) for p in (1, 2) for i, j, k in itertools.product(range(n), repeat=3) if rng.random() < share]
    return graph.node_ids(spark.createDataFrame(cells, "plant_id long, i long, j long, k long"))


def test_distance_transform(spark):
    nodes = plant(spark, share=0.8)
    cells = {(r.plant_id, r.i, r.j, r.k) for r in nodes.collect()}
    for r in graph.distance_transform(nodes, (6, 6, 6)).collect():
        want = min((r.i - a) ** 2 + (r.j - b) ** 2 + (r.k - c) ** 2 for a, b, c in itertools.product(range(6), repeat=3) if (r.plant_id, a, b, c) not in cells)
        assert r.dt == pytest.approx(math.sqrt(want))


def test_paths(spark):
    nodes = plant(spark)
    edges = graph.edges(nodes)
    adjacent = {}
    for r in graph.both_ways(edges).collect():
        adjacent.setdefault((r.plant_id, r.u), []).append((r.v, r.d))
    start = nodes.groupBy("plant_id").agg(F.min("node_id").alias("node_id"))
    sp = graph.shortest_paths(edges, start)
    got = {(r.plant_id, r.node_id): r.dist for r in sp.collect()}
    for p, s in ((r.plant_id, r.node_id) for r in start.collect()):
        best, heap = {}, [(0.0, s)]
        while heap:
            x, u = heapq.heappop(heap)
            if u not in best:
                best[u] = x
                for v, d in adjacent.get((p, u), []):
                    heapq.heappush(heap, (x + d, v))
        assert {k[1]: pytest.approx(v) for k, v in got.items() if k[0] == p} == best
    tips = sp.orderBy(F.desc("dist")).limit(3).select("plant_id", "node_id")
    for (p, tip), rows in itertools.groupby(sorted(graph.extract_paths(sp, tips).collect(), key=lambda r: (r.plant_id, r.tip, r.seq)), key=lambda r: (r.plant_id, r.tip)):
        way = [r.node_id for r in rows]
        length = sum(dict(adjacent[p, a])[b] for a, b in zip(way, way[1:], strict=False))
        assert way[0] == tip and got[p, way[-1]] == 0 and length == pytest.approx(got[p, tip])


def test_join_tree(spark):
    nodes = plant(spark, seed=9)
    u = nodes.select("plant_id", "node_id", ((F.col("node_id") * 37) % 101).cast("double").alias("u"))
    edges = graph.edges(nodes)
    value = {(r.plant_id, r.node_id): r.u for r in u.collect()}
    adjacent = {}
    for r in graph.both_ways(edges).collect():
        adjacent.setdefault((r.plant_id, r.u), []).append(r.v)
    want = {}
    for p in (1, 2):
        own = sorted((n for q, n in value if q == p), key=lambda n: (-value[p, n], n))
        top = {}

        def find(n, top=top):
            while top[n] != n:
                n = top[n]
            return n

        for n in own:
            top[n] = n
            peaks = sorted({find(m) for m in adjacent.get((p, n), []) if m in top and m != n}, key=lambda m: (-value[p, m], m))
            if peaks:
                top[n] = peaks[0]
                for low in peaks[1:]:
                    top[low] = peaks[0]
                    want[p, low] = value[p, low] - value[p, n]
            else:
                want[p, n] = math.inf
    got = {(r.plant_id, r.peak): r.prominence for r in graph.prominences(u, edges).collect()}
    assert got == want


def curve(spark, points):
    return spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(points)], "curve_id int, seq int, x double, y double, z double")


def test_curves(spark):
    line = curve(spark, [(k / 6, k / 3, k / 3) for k in range(61)])
    dense = curves.smooth_curves(line, 1.5).orderBy("seq").collect()
    assert dense[-1].s == pytest.approx(30, rel=1e-6) and dense[50].y == pytest.approx(2 * dense[50].x)
    helix = curve(spark, [(10 * math.cos(t), 10 * math.sin(t), 2 * t) for t in (4 * math.pi * k / 799 for k in range(800))])
    assert curves.smooth_curves(helix, 1.0).agg(F.max("s")).first()[0] == pytest.approx(4 * math.pi * math.sqrt(104), rel=0.01)
    zigzag = curve(spark, [(0.3 * (-1) ** k, 0, k / 2) for k in range(201)])
    assert curves.smooth_curves(zigzag, 1.5).agg(F.max("s")).first()[0] == pytest.approx(100, rel=0.02)
    target = spark.createDataFrame([(1, 1, 5.0, 10.0, 10.2)], "curve_id int, target_id int, qx double, qy double, qz double")
    assert curves.project_points(target, curves.smooth_curves(line, 1.5), line, 1.5).first().t == pytest.approx((5 + 20 + 20.4) / 3, abs=1e-3)


def test_feet_on_smooth_curves(spark):
    """The closest place of a helix by dense evaluation; beyond the ends the ends are it."""
    way = curve(spark, [(10 * math.cos(t), 10 * math.sin(t), 2 * t) for t in (4 * math.pi * k / 199 for k in range(200))])
    dense = curves.smooth_curves(way, 1.0)
    asked = [(1, k, 12 * math.cos(0.7 * k), 9 * math.sin(0.7 * k), 1.3 * k) for k in range(1, 17)] + [(1, 90, 10.0, -9.0, -5.0), (1, 91, 10.0, 9.0, 60.0)]
    got = {r.target_id: r for r in curves.project_points(spark.createDataFrame(asked, "curve_id int, target_id int, qx double, qy double, qz double"), dense, way, 1.0).collect()}
    assert len(got) == len(asked)
    end = dense.agg(F.max("t")).first()[0]
    fine = spark.range(20001).select(F.lit(1).alias("curve_id"), F.col("id").alias("k"), (F.col("id") * end / 20000).alias("t"))
    places = [(r.x, r.y, r.z) for r in curves.kernel_positions(fine, curves.arc_length(way), 1.0).orderBy("k").collect()]
    for _, k, *q in asked:
        assert got[k].dist == pytest.approx(min(math.dist(q, p) for p in places), abs=1e-4)


def test_sparse_points_take_the_two_around(spark):
    """No point lies within reach of the query: the two around it count, by their weights; every query keeps its row."""
    way = curve(spark, [(0, 0, 0), (100, 0, 0), (200, 0, 0)])
    at = spark.createDataFrame([(1, 49.0), (1, 50.0), (1, 100.0)], "curve_id int, t double")
    out = {r.t: r for r in curves.kernel(at, curves.arc_length(way), 2.0).collect()}
    assert out[50.0].x == pytest.approx(50) and out[50.0].dx > 0 and out[100.0].x == pytest.approx(100) and out[49.0].x < 1


def test_line_elements():
    """Offsets by hand at a half-length of 2; a line reaches its full length along its main axis at every angle."""
    assert image.line_element(2, math.pi / 4) == [(-2, -2), (-1, -1), (1, 1), (2, 2)]
    assert image.line_element(2, math.pi / 8) == [(-1, -2), (-1, -1), (1, 1), (1, 2)]
    assert image.line_element(2, 0) == [(0, -2), (0, -1), (0, 1), (0, 2)] and image.line_element(0, 1.0) == []
    assert all(max(max(abs(a), abs(b)) for a, b in image.line_element(5, k * math.pi / 20)) == 5 for k in range(20))


def test_tiles_do_not_change_images(spark):
    rng = random.Random(5)
    rows = [(1, 1, r, c, rng.random()) for r in range(1, 31) for c in range(1, 24) if rng.random() < 0.95]
    feat = spark.createDataFrame(rows, "plant_id int, frame_idx int, row int, col int, feat double")
    whole = lambda f: {(r.row, r.col): round(r.feat, 9) for r in f.collect()}
    for op in (lambda t: image.thin_lines(feat, 2, t), lambda t: image.blur(feat, 1.5, t), lambda t: image.opening(feat, image.box_element(1), t)):
        assert whole(op(7)) == whole(op(256)) and len(whole(op(7))) == len(rows)


def test_bricks_do_not_change_smoothing(spark):
    """Bricks of three voxels, halos of four steps, and the dense solution."""
    import numpy as np

    rng = random.Random(2)
    cells = [(i, j, k) for i in range(7) for j in range(5) for k in range(4) if rng.random() < 0.9]
    lod = spark.createDataFrame([(1, *c, rng.uniform(-9, 9)) for c in cells], "plant_id int, i long, j long, k long, lod double")
    value = {(r.i, r.j, r.k): r.lod for r in lod.collect()}
    place = {c: n for n, c in enumerate(cells)}
    a = np.eye(len(cells))
    for c in cells:
        for step in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
            o = tuple(x + y for x, y in zip(c, step, strict=True))
            if o in place:
                w, u, v = 3.0 * math.exp(-(((value[c] - value[o]) / 10) ** 2)), place[c], place[o]
                a[u, u] += w
                a[v, v] += w
                a[u, v] -= w
                a[v, u] -= w
    want = np.linalg.solve(a, [value[c] for c in cells])
    for brick, halo in ((3, 4), (64, 20)):
        got = {(r.i, r.j, r.k): r.smoothed for r in volume.smooth(lod, 10.0, 3.0, brick=brick, halo=halo).collect()}
        assert [got[c] for c in cells] == pytest.approx(list(want), abs=1e-7)


def test_votes_by_slab(spark):
    grids = spark.createDataFrame([(1, -2.0, -2.0, 8.0, 4.0, 4.0, 4.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "plant_id int, ox double, oy double, oz double, wx double, wy double, wz double, voxel_size double")
    frames = spark.createDataFrame([frame()], FRAME)
    mask = spark.createDataFrame([(1, 1, r, c) for r in range(1, 49) for c in range(1, 65) if (r + c) % 3], "plant_id int, frame_idx int, row int, col int")
    counts = lambda slab: {tuple(r) for r in volume.vote_counts(grids, frames, mask, slab).collect()}
    pixels = camera.project(camera.voxels_from_bbox(grids), frames).join(mask.withColumn("hit", F.lit(1)), ["plant_id", "frame_idx", "row", "col"], "left")
    want = {(r.plant_id, r.i, r.j, r.k, 1, int(r.hit is not None)) for r in pixels.collect()}
    got = counts(1 << 20)
    assert got == counts(30) and {r for r in got if r[4]} == want and len(got) == 125 + 8


def test_paths_do_not_depend_on_blocks(spark):
    """A stem of 1200 steps in a row, and a mesh: blocks of any size give what a heap gives."""
    rng = random.Random(9)
    links = [(1, n, n + 1, 1.0 + n % 7) for n in range(1, 1200)] + [(2, a, b, float(rng.randint(1, 9))) for a in range(1, 90) for b in {rng.randint(1, 90) for _ in range(4)} if a < b]
    e = spark.createDataFrame(links, "plant_id int, u long, v long, w double")
    sources = spark.createDataFrame([(1, 1), (2, 5), (2, 60)], "plant_id int, node_id long")
    near: dict[tuple[int, int], tuple[float, int]] = {}
    around: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for p, u, v, w in links:
        around.setdefault((p, u), []).append((v, w))
        around.setdefault((p, v), []).append((u, w))
    heap = [(0.0, n, p, n) for p, n in ((1, 1), (2, 5), (2, 60))]
    while heap:
        d, s, p, n = heapq.heappop(heap)
        if (p, n) not in near:
            near[p, n] = (d, s)
            for m, w in around.get((p, n), []):
                heapq.heappush(heap, (d + w, s, p, m))
    for block in (16, 1 << 14):
        sp = graph.shortest_paths(e, sources, "w", block=block)
        got = {(r.plant_id, r.node_id): (r.dist, r.nearest_source) for r in sp.collect()}
        assert got == near
        ends = spark.createDataFrame([(1, 1200), (2, 33)], "plant_id int, node_id long")
        ways = graph.extract_paths(sp, ends, block).orderBy("plant_id", "seq").collect()
        assert [r.node_id for r in ways if r.plant_id == 1] == list(range(1200, 0, -1))
        assert [r.node_id for r in ways if r.plant_id == 2][-1] == near[2, 33][1]
    bound = graph.shortest_paths(e, sources, "w", targets=spark.createDataFrame([(1, 40)], "plant_id int, node_id long"), block=16)
    assert {(r.plant_id, r.node_id) for r in bound.collect()} == {k for k, (d, _) in near.items() if k[0] == 2 or d <= near[1, 40][0]}


def test_sweep_takes_the_tall_side(spark):
    """A pass beside a low node of a tall peak and a higher node of a low one belongs to the tall peak when it is swept."""
    u = spark.createDataFrame([(1, n + 1, float(h)) for n, h in enumerate((10, 5, 4, 6, 7))], "plant_id int, node_id long, u double")
    e = spark.createDataFrame([(1, n, n + 1) for n in range(1, 5)], "plant_id int, u long, v long")
    assert {r.node_id: r.peak for r in graph.basins(u, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 5, 5: 5}
    low = graph.prominences(u, e).where("peak = 5").first()
    assert (low.saddle_node, low.saddle_val, low.parent, low.prominence) == (3, 4.0, 1, 3.0)


def test_surface_of_a_ball_is_closed(spark):
    cells = [(1, i, j, k, 3.2 - math.dist((i, j, k), (5, 5, 5))) for i in range(11) for j in range(11) for k in range(11)]
    grids = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], "plant_id int, ox double, oy double, oz double, voxel_size double")
    vertices, triangles = volume.isosurface(spark.createDataFrame(cells, "plant_id int, i long, j long, k long, lod double"), grids, 0.0)
    at = {(tuple(r.a), tuple(r.b)): (r.x, r.y, r.z) for r in vertices.collect()}
    assert all(abs(math.dist(p, (5.5, 5.5, 5.5)) - 3.2) < 0.2 for p in at.values())
    sides, volume6 = {}, 0.0
    for r in triangles.collect():
        own = [(tuple(c.a), tuple(c.b)) for c in r.corners]
        for a, b in zip(own, own[1:] + own[:1], strict=True):
            sides[a, b] = sides.get((a, b), 0) + 1
        p, q, s = (at[c] for c in own)
        volume6 += p[0] * (q[1] * s[2] - q[2] * s[1]) - p[1] * (q[0] * s[2] - q[2] * s[0]) + p[2] * (q[0] * s[1] - q[1] * s[0])
    assert all(n == 1 and sides.get((b, a)) == 1 for (a, b), n in sides.items())
    assert volume6 / 6 == pytest.approx(4 / 3 * math.pi * 3.2**3, rel=0.05)


def test_angles(spark):
    rows = []
    for k, (theta, phi) in enumerate(itertools.product((0.3, math.pi / 2, 2.0), (0.1, 2.4, 5.5))):
        rows.append((k, 0.0, 0.0, 1.0, math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta), 1.0, 0.0, 0.0, theta, phi))
    frame_ = spark.createDataFrame(rows, "k int, sx double, sy double, sz double, bx double, by double, bz double, rx double, ry double, rz double, t double, p double")
    for r in measure.polar_azimuth(frame_).collect():
        assert r.theta == pytest.approx(r.t) and r.phi == pytest.approx(r.p)
    along = frame_.limit(1).withColumns({"bx": F.lit(0.0), "by": F.lit(0.0), "bz": F.lit(1.0)})
    assert math.isnan(measure.polar_azimuth(along).first().phi)


def test_winding(spark):
    golden = math.radians(137.5)
    plants = {1: [k * golden for k in range(8)], 2: [-k * golden for k in range(8)], 3: [0.0, 1.0, 0.0], 4: [0.0, float("nan"), 1.0, 2.0]}
    rows = [(p, k + 1, a % (2 * math.pi), 10.0 * k) for p, v in plants.items() for k, a in enumerate(v)]
    fruits = spark.createDataFrame(rows, "plant_id int, fruit_id int, azimuth double, arc double")
    assert {r.plant_id: r.orientation for r in measure.chirality(fruits).collect()} == {1: "ccw", 2: "cw", 3: "ambiguous", 4: "ccw"}
    angles = [r.div_angle for r in measure.divergence(fruits).where("plant_id < 3 and fruit_id > 1").collect()]
    assert angles == pytest.approx([137.5] * 14)


def test_quadratic_fit(spark):
    rows = [(1, u, math.exp(-u * u / 2), 1 + 2 * u + 3 * u * u, -u, 0.5 * u * u) for u in (k / 10 - 1.5 for k in range(31))]
    fit = measure.quadratic_fit(spark.createDataFrame(rows, "f int, u double, w double, x double, y double, z double"), ["f"]).first()
    assert (fit.b0x, fit.b1x, fit.b2x, fit.b1y, fit.b2z) == pytest.approx((1, 2, 3, -1, 0.5)) and fit.se == pytest.approx(0, abs=1e-6)


def test_tip_edits(spark):
    tips = spark.createDataFrame([(1, 5, 0), (1, 9, 3)], "plant_id int, node_id int, stem_target int")
    keys = ["plant_id", "node_id"]
    gone = results.remove(tips, tips.where("node_id = 5"), keys)
    assert sorted(results.upsert(gone, tips.where("node_id = 5"), keys).collect()) == sorted(tips.collect())
    assert results.remove(tips, spark.createDataFrame([(1, 77)], "plant_id int, node_id int"), keys).count() == 2
