"""Components by runs: long ways in few rounds, debris, empty plants, odd cells."""

import random

from plantmill.jobs import skeleton as sk
from plantmill.operators import components
from plantmill.operators.components import cut
from tests.test_skeleton import DIMS, cells

AXES = ["i", "j", "k"]
VOXELS = "plant_id long, i long, j long, k long"


def flooded(voxels):
    """voxel -> first voxel of its component, for a set of voxels."""
    out = {}
    for start in sorted(voxels):
        if start not in out:
            todo = [start]
            out[start] = start
            while todo:
                c = todo.pop()
                for a in range(3):
                    for step in (-1, 1):
                        n = (*c[:a], c[a] + step, *c[a + 1 :])
                        if n in voxels and n not in out:
                            out[n] = start
                            todo.append(n)
    return out


def test_random_cells_equal_flooding(spark):
    rng = random.Random(3)
    plants = {p: {(rng.randrange(9), rng.randrange(9), rng.randrange(9)) for _ in range(n)} for p, n in ((1, 250), (2, 60), (3, 1))}
    rows = [(p, *c) for p, v in plants.items() for c in v]
    got = components.cell_components(spark.createDataFrame(rows + rows[:5], VOXELS), ["plant_id"], AXES).collect()
    assert len(got) == len(rows)
    want = {p: flooded(v) for p, v in plants.items()}
    assert all(tuple(r.label) == want[r.plant_id][r.i, r.j, r.k] for r in got)
    assert components.cell_components(spark.createDataFrame([], VOXELS), ["plant_id"], AXES).count() == 0


def test_spiral_of_500_slices_takes_few_rounds(spark):
    """A way that turns through every slice; rounds grow with the logarithm of its length."""
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    rows = [(1, *ring[n % 8], n // 8 * 2) for n in range(2000)] + [(1, *ring[(8 * n + 7) % 8], 2 * n + 1) for n in range(250)] + [(1, *ring[0], 2 * n) for n in range(250)]
    voxels = {r[1:] for r in rows}
    frame = spark.createDataFrame([(1, *c) for c in voxels] + [(1, 9, 9, 9)], VOXELS)
    _, runs = components.cell_runs(frame, ["plant_id"], AXES)
    assert runs.count() > 900
    chain = spark.range(4000).selectExpr("id as u", "id + 1 as v")
    assert {r.label for r in components.labels(chain.selectExpr("u as node"), chain, most=12).select("label").distinct().collect()} == {0}
    want = flooded(voxels)
    got = components.cell_components(frame, ["plant_id"], AXES).where("i < 9").collect()
    assert {(r.i, r.j, r.k): tuple(r.label) for r in got} == want


def test_debris_leaves_the_skeleton_as_it_is(spark):
    stray = [(1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (2, 12, 12, 11)]
    clean = sk.skeleton(spark.createDataFrame(cells(1) + cells(2), VOXELS), DIMS, sk.Params(h=2.5))
    dirty = sk.skeleton(spark.createDataFrame(cells(1) + stray + cells(2), VOXELS), DIMS, sk.Params(h=2.5))
    for part in ("nodes", "root", "top", "tips", "stem", "branches"):
        assert sorted(map(repr, getattr(clean, part).collect())) == sorted(map(repr, getattr(dirty, part).collect())), part
    plants = spark.createDataFrame([(1,), (2,), (7,), (7,)], "plant_id long")
    assert [tuple(r) for r in sk.empty_plants(plants, dirty.nodes).collect()] == [(7, "no voxel above the threshold")]


def test_cut_tables_know_their_size(spark):
    """Self-joins square a plan's size estimate; a cut table begins again from the size of its files."""
    rows = cut(spark.range(20).selectExpr("id % 5 AS a", "id AS b"))
    for _ in range(6):
        rows = cut(rows.join(rows.withColumnRenamed("b", "c"), "a").groupBy("a").agg({"c": "max"}).withColumnRenamed("max(c)", "b"))
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 32
    assert sorted(map(tuple, rows.collect())) == [(a, a + 15) for a in range(5)]
