"""A plant made of a stem and two side branches, and one that is moved by hand."""

from plantmill.jobs import skeleton as sk

DIMS = (13, 13, 12)


def cells(plant):
    stem = {(i, j, k) for i in (5, 6, 7) for j in (5, 6, 7) for k in range(11)}
    arms = {(i, 6, 3) for i in range(8, 12)} | {(6, j, 5) for j in range(1, 5)}
    return [(plant, *c) for c in stem | arms]


def test_two_plants(spark):
    occupied = spark.createDataFrame(cells(1) + cells(2), "plant_id long, i long, j long, k long")
    out = sk.skeleton(occupied, DIMS, sk.Params(h=2.5))
    place = {(r.plant_id, r.node_id): (r.i, r.j, r.k) for r in out.nodes.collect()}
    assert {(r.plant_id, *place[r.plant_id, r.node_id]) for r in out.tips.collect()} == {(p, *c) for p in (1, 2) for c in ((11, 6, 3), (6, 1, 5))}
    stem = [place[1, r.node_id] for r in sorted(out.stem.where("plant_id = 1").collect(), key=lambda r: r.seq)]
    assert stem[0][2] == 0 and stem[-1][2] == 10 and all(abs(a[2] - b[2]) <= 1 for a, b in zip(stem, stem[1:], strict=False))
    for tip, end in (((11, 6, 3), (5, 7)), ((6, 1, 5), (5, 7))):
        node = next(n for (p, n), c in place.items() if p == 2 and c == tip)
        way = [place[2, r.node_id] for r in sorted(out.branches.where(f"plant_id = 2 and tip = {node}").collect(), key=lambda r: r.seq)]
        assert way[-1] == tip and end[0] <= way[0][0] <= end[1] and 5 <= way[0][1] <= 7
