"""Jobs whose sides Spark takes for smaller than they are: nothing that grows with the voxels or points is broadcast."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plantmill.jobs import catalog
from plantmill.operators import camera, components, curves, graph
from plantmill.sources import tables
from plantmill.sources.tables import load

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that an operator cuts."""
    seen = []

    def watch(module):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
        return seen

    return watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_points_meet_in_chunks(spark, monkeypatch, plans):
    seen = plans(curves)
    rng = random.Random(5)
    place = lambda: tuple(rng.randrange(40) / 4 for _ in range(3))
    points = [(c, n + 1, 0.5 * n, 0.5 * n, *place()) for c, size in ((1, 90), (2, 7), (3, 1)) for n in range(size)]
    asked = [(c, n, *place()) for c, size in ((1, 60), (2, 30), (4, 5)) for n in range(size)]
    dense = spark.createDataFrame(points, "curve_id long, seq int, t double, s double, x double, y double, z double")
    targets = spark.createDataFrame(asked, "curve_id long, target_id long, qx double, qy double, qz double")
    want = {}
    for c, n, *q in asked:
        if own := [(sum((a - b) ** 2 for a, b in zip(p[4:], q, strict=True)), p[1], p[2], p[3]) for p in points if p[0] == c]:
            want[c, n] = min(own)
    for chunk in (8, 512):
        monkeypatch.setattr(curves, "CHUNK", chunk)
        found = curves.nearest_points(targets, dense)
        assert not any("Broadcast" in x for x in [*seen, plan(found)])
        assert {(r.curve_id, r.target_id): (r.dist2, r.seq, r.t, r.s) for r in found.collect()} == want


def solid(spark):
    """Two plants over several bricks, with their distances."""
    rng = random.Random(7)
    voxels = [(1, i, j, k) for i in range(12, 21) for j in range(3, 10) for k in range(20) if rng.random() < 0.95] + [(2, 0, 0, 0)]
    ids = {v: n + 1 for n, v in enumerate(sorted(voxels, key=lambda v: (v[0], v[3], v[2], v[1])))}
    rows = [(p, ids[p, i, j, k], i, j, k, rng.choice((1.0, 2.0, 2.0**0.5, 3.0))) for p, i, j, k in voxels]
    return rows, components.cut(spark.createDataFrame(rows, "plant_id long, node_id long, i long, j long, k long, dt double"))


def test_neighbours_of_bricks(spark):
    rng = random.Random(1)
    cells = [(p, rng.randrange(-20, 20), rng.randrange(-3, 3), f"c{n}") for n in range(400) for p in ("a", "b")] + [("a", None, 0, "x")]
    frame = spark.createDataFrame(cells, "plant string, i int, j int, name string")
    found = components.neighbours(frame, ["plant"], ["i", "j"], [(1, 0), (-1, 1)], ["name"])
    here = [c for c in cells if c[1] is not None]
    want = sorted((a[0], a[1], a[2], a[3], b[1], b[2], b[3]) for a, b in itertools.product(here, here) if a[0] == b[0] and (b[1] - a[1], b[2] - a[2]) in ((1, 0), (-1, 1)))
    assert sorted(tuple(r) for r in found.collect()) == want and "Broadcast" not in plan(found)


def test_radii_send_no_cells_to_the_driver(spark):
    rows, dt = solid(spark)
    found = graph.local_radius(dt)
    assert "Broadcast" not in plan(found)
    maximal = {tuple(r)[:2] for r in graph.maximal_balls(dt).select("plant_id", "node_id").collect()}
    balls = [r for r in rows if r[:2] in maximal]
    want = {v[:2]: max(d) for v in rows if (d := [b[5] for b in balls if b[0] == v[0] and sum((x - y) ** 2 for x, y in zip(b[2:5], v[2:5], strict=True)) <= (b[5] + 0.5) ** 2])}
    assert {(r.plant_id, r.node_id): r.radius for r in found.collect()} == want


def test_conductance_broadcasts_no_radii(spark):
    _, dt = solid(spark)
    assert "Broadcast" not in plan(graph.conductance(dt, components.cut(dt.select("plant_id", "node_id", (dt.dt + 1).alias("radius")))))


def test_travel_times_broadcast_no_edges(spark):
    _, dt = solid(spark)
    e, radius = components.cut(graph.edges(dt)), components.cut(dt.select("plant_id", "node_id", (dt.dt + 1).alias("radius")))
    found = graph.reweighted(e, dt, radius, 3.0, 0.05)
    assert "Broadcast" not in plan(found) and found.count() == e.count()


def test_points_made_by_generators_are_not_broadcast(spark):
    grids, frames = load(spark, SF, "grids"), load(spark, SF, "frames")
    assert "BroadcastHashJoin" not in plan(camera.project(camera.voxels_from_bbox(grids), frames, to_pixel=False))


def test_voxels_grow_after_their_frames_are_met(spark):
    grids, frames = load(spark, SF, "grids"), load(spark, SF, "frames")
    for to_pixel in (False, True):
        found, want = camera.project_voxels(grids, frames, to_pixel), camera.project(camera.voxels_from_bbox(grids), frames, to_pixel).drop("x", "y", "z")
        text = plan(found)
        assert "BroadcastHashJoin" not in text and found.columns == want.columns
        assert text.rindex("Generate explode") < text.index("SortMergeJoin")
        assert found.count() == want.count() and found.exceptAll(want).isEmpty()


def test_image_bytes_are_laid_in_one_pass(spark):
    """A map is searched from its beginning for each key, which was quadratic in an image's pixels."""
    found = catalog.s6_image_pixels(spark, SF)
    assert "map_from_entries" not in plan(found)
    image = load(spark, SF, "pixels")
    first = image.select("plant_id", "frame_idx").first()
    assert found.where((F.col("plant_id") == first[0]) & (F.col("frame_idx") == first[1])).count() == tables.ROWS * tables.COLS


def test_dense_points_are_made_in_pieces_and_not_shuffled(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, n, float(rng.randrange(9)) if n % 40 else 60.0, float(n % 5), n / 2) for c, size in ((1, 80), (2, 2), (3, 1)) for n in range(size)] + [(4, n, 1.0, 1.0, 1.0) for n in range(3)]
    points = spark.createDataFrame(rows, "curve_id int, seq int, x double, y double, z double")
    whole = curves.smooth_curves(points, 2.0)
    text = plan(whole)
    assert "Broadcast" not in text and "Exchange" not in text[: text.index("MapInArrow")]
    monkeypatch.setattr(curves, "PIECE", 32)
    got, want = (sorted((r.curve_id, r.seq, *(round(r[c], 6) + 0.0 for c in ("t", "s", "x", "y", "z"))) for r in df.collect()) for df in (curves.smooth_curves(points, 2.0), whole))
    assert {r[0] for r in want} == {1, 2, 4} and len(want) > 500 and got == want


def test_queries_meet_packed_points(spark, monkeypatch):
    """No row is made for a query and a point; queries may lie beyond a curve or in a gap, and pieces change nothing."""
    places = {1: [0.0, 1.0, 2.5, 40.0, 41.0, 90.0], 2: [3.0 * n for n in range(30)]}
    profile = spark.createDataFrame([(c, n, t, t, float(n % 3), 1.0) for c, own in places.items() for n, t in enumerate(own)], "curve_id long, seq int, t double, x double, y double, z double")
    at = spark.createDataFrame([(c, n, -30.0 + 1.7 * n, "q") for c in (1, 2, 3) for n in range(90)], "curve_id long, n int, t double, name string")
    found = curves.kernel(at, profile, 1.0)
    assert "Broadcast" not in plan(found)
    pads = {c: sorted((r.t, r.x) for r in curves.padded(profile, 6.0).where(F.col("curve_id") == c).collect()) for c in places}
    want = {}
    for c, own in pads.items():
        for n in range(90):
            t = -30.0 + 1.7 * n
            near = [p for p in own if abs(p[0] - t) <= 6.0] or [p for p in (max([p for p in own if p[0] <= t], default=None), min([p for p in own if p[0] > t], default=None)) if p]
            least = min(abs(p[0] - t) for p in near) ** 2
            weights = [math.exp((least - (p[0] - t) ** 2) / 2) for p in near]
            want[c, n, "q"] = pytest.approx(sum(w * p[1] for w, p in zip(weights, near, strict=True)) / sum(weights))
    got = {(r.curve_id, r.n, r.name): r.x for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want)
    monkeypatch.setattr(curves, "SPAN", 1)
    again = {(r.curve_id, r.n, r.name): r.x for r in curves.kernel(at, profile, 1.0).collect()}
    assert again == pytest.approx(got)
