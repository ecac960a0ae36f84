"""The voxel graph of a plant: node ids, distances, radii, conductance, paths, tips and the join tree.

A node id is the rank of an occupied voxel in (k, j, i) order, from 1. Ties always go to the smaller node id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmill.operators import components
from plantmill.operators.components import cut, neighbours

AXES = ["i", "j", "k"]
NODE = ["plant_id", "node_id"]
# One of each pair of opposite offsets to the 26 neighbours.
HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)]
BLOCK = 1 << 14  # node ids of a block
FULL = HALF + [(-a, -b, -c) for a, b, c in HALF]


def node_ids(occupied: DataFrame) -> DataFrame:
    """Occupied voxels with node_id. Slices are counted first, so that one plant's voxels are ranked slice by slice."""
    slices = occupied.groupBy("plant_id", "k").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("plant_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("plant_id", "k").orderBy("j", "i"))
    offsets = slices.select("plant_id", "k", before.alias("before"))
    return occupied.withColumn("rank", inside).join(offsets, ["plant_id", "k"]).select("plant_id", (F.col("before") + F.col("rank")).alias("node_id"), *AXES)


def edges(nodes: DataFrame) -> DataFrame:
    """plant_id, u, v, d: 26-neighbour edges once each (u < v), with their length."""
    met = neighbours(nodes, ["plant_id"], AXES, HALF, ["node_id"])
    d = F.sqrt(sum((F.col(a) - F.col(f"n_{a}")) * (F.col(a) - F.col(f"n_{a}")) for a in AXES).cast("double"))
    return met.select("plant_id", F.least("node_id", "n_node_id").alias("u"), F.greatest("node_id", "n_node_id").alias("v"), d.alias("d"))


def both_ways(e: DataFrame) -> DataFrame:
    rest = [c for c in e.columns if c not in ("u", "v")]
    return e.select("u", "v", *rest).union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def distance_transform(nodes: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """plant_id, node_id, i, j, k, dt: distance to the nearest background voxel inside the box (its faces are none).

    Three passes along the axes of min(g + difference^2). The first is a window; the others are joins along a line whose
    reach is bounded by the distance found so far. A plant without background has a null distance.
    """
    side = F.lit(sum(d * d for d in dims) + 1)
    lines = Window.partitionBy("plant_id", "j", "k").orderBy("i")
    # Along i, within runs of occupied voxels: the gap before and after a voxel holds the nearest background.
    first = nodes.withColumn("before", F.lag("i").over(lines)).withColumn("run", F.sum(F.when(F.col("before") == F.col("i") - 1, 0).otherwise(1)).over(lines))
    ends = Window.partitionBy("plant_id", "j", "k", "run")
    low, high = F.min("i").over(ends) - 1, F.max("i").over(ends) + 1
    near = F.least(F.when(low >= 0, F.col("i") - low), F.when(high < dims[0], high - F.col("i")))
    g = first.select(*NODE, *AXES, F.coalesce(near * near, side).cast("long").alias("g"))
    for axis, others in (("j", ["i", "k"]), ("k", ["i", "j"])):
        size = dims[AXES.index(axis)]
        # An unoccupied cell of a line counts as 0: the nearest one before and after each voxel.
        w = Window.partitionBy("plant_id", *others).orderBy(axis)
        run = g.withColumn("_b", F.lag(axis).over(w)).withColumn("run", F.sum(F.when(F.col("_b") == F.col(axis) - 1, 0).otherwise(1)).over(w))
        span = Window.partitionBy("plant_id", *others, "run")
        lo, hi = F.min(axis).over(span) - 1, F.max(axis).over(span) + 1
        gap = F.least(F.when(lo >= 0, F.col(axis) - lo), F.when(hi < size, hi - F.col(axis)))
        run = run.withColumn("own", F.least("g", F.coalesce(gap * gap, side)))
        here, there = run.select(*NODE, *AXES, "run", "own"), run.select("plant_id", *others, "run", F.col(axis).alias("at"), F.col("g").alias("other"))
        met = here.join(there, ["plant_id", *others, "run"]).where((F.col("at") - F.col(axis)) * (F.col("at") - F.col(axis)) <= F.col("own"))
        g = met.groupBy(*NODE, *AXES).agg(F.least(F.min("own"), F.min(F.col("other") + (F.col("at") - F.col(axis)) * (F.col("at") - F.col(axis)))).cast("long").alias("g"))
    return g.select(*NODE, *AXES, F.when(F.col("g") < side, F.sqrt(F.col("g").cast("double"))).alias("dt"))


def boundary(nodes: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """The nodes with an unoccupied face neighbour inside the box."""
    inside = sum(((F.col(a) > 0).cast("int") + (F.col(a) < n - 1).cast("int")) for a, n in zip(AXES, dims, strict=True))
    near = neighbours(nodes, ["plant_id"], AXES, components.face_offsets(3), ["node_id"]).groupBy("plant_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(near, NODE, "left").where(F.coalesce("n", F.lit(0)) < inside).select(*NODE)


def truncation(nodes: DataFrame, dims: tuple[int, int, int], least: int = 3, faces: tuple[str, ...] = ("i0", "i1", "j0", "j1", "k0", "k1")) -> DataFrame:
    """plant_id, face, label, node_id: voxels on faces of the box, in face-connected components of at least `least`."""
    spots = F.array_compact(F.array(*(F.when(F.col(f[0]) == (0 if f[1] == "0" else dims[AXES.index(f[0])] - 1), F.lit(f)) for f in faces)))
    on = nodes.select(*NODE, *AXES, F.explode(spots).alias("face"))
    # A face's own axis is constant, so the 3-D face neighbours within a face are its 2-D ones.
    found = components.cell_components(on.select("plant_id", "face", *AXES), ["plant_id", "face"], AXES)
    big = components.component_sizes(found, ["plant_id", "face"]).where(F.col("size") >= least)
    return found.join(big, ["plant_id", "face", "label"], "left_semi").join(on, ["plant_id", "face", *AXES]).select("plant_id", "face", "label", "node_id")


def truncated_tips(found: DataFrame, dt: DataFrame) -> DataFrame:
    """plant_id, face, node_id: the deepest voxel of each component that `truncation` found on the faces other than the bottom."""
    met = found.where("face <> 'k0'").join(dt.select(*NODE, "dt"), NODE)
    best = met.groupBy("plant_id", "face", "label").agg(F.min(F.struct((-F.col("dt")).alias("d"), "node_id")).alias("b"))
    return best.select("plant_id", "face", F.col("b.node_id").alias("node_id"))


def maximal_balls(dt: DataFrame) -> DataFrame:
    """The nodes whose ball no 26-neighbour's ball contains: none has dt >= own dt + step."""
    met = neighbours(dt, ["plant_id"], AXES, FULL, ["node_id", "dt"])
    step = F.sqrt(sum((F.col(a) - F.col(f"n_{a}")) * (F.col(a) - F.col(f"n_{a}")) for a in AXES).cast("double"))
    inner = met.where(F.col("n_dt") >= F.col("dt") + step - 1e-9).select(*NODE).distinct()
    return dt.join(inner.hint("merge"), NODE, "left_anti")


def local_radius(dt: DataFrame) -> DataFrame:
    """plant_id, node_id, radius: the largest maximal ball (dt + 1/2) that covers a node.

    A ball goes to the bricks that it reaches, and a brick with its balls is one row; the cells of balls are never rows.
    """
    columns, bricks = ["node_id", *AXES, "dt"], [f"_b_{a}" for a in AXES]
    components.whole_unions(dt.sparkSession)
    balls = components.in_bricks(maximal_balls(dt).where("dt is not null").select("plant_id", *columns), ["plant_id"], AXES, F.ceil(F.col("dt") + 0.5).cast("long"))
    own = components.in_bricks(dt.select("plant_id", *columns), ["plant_id"], AXES)
    both = balls.withColumn("ball", F.lit(True)).unionByName(own.withColumn("ball", F.lit(False)))
    packed = both.groupBy("plant_id", *bricks).agg(F.collect_list(F.struct("ball", *columns)).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, own), rows = components.flat(batch.column("_c")), batch.column("_c").flatten()
            ball, r = own["ball"].astype(bool), own["dt"].astype(float)
            for k in range(batch.num_rows):
                at = np.arange(ends[k], ends[k + 1])
                left, there = at[~ball[at]], at[ball[at]]
                there = there[np.argsort(-r[there], kind="stable")]
                node, radius = [left[:0]], [r[:0]]
                # From the largest ball on: the first that covers a node is its own.
                for n in range(0, len(there), 64):
                    some = there[n : n + 64]
                    square = sum(np.square(own[a][left].astype(np.int64)[:, None] - own[a][some].astype(np.int64)[None, :]) for a in AXES)
                    covers = square <= np.square(r[some] + 0.5)
                    found = covers.any(1)
                    node.append(left[found])
                    radius.append(r[some][covers[found].argmax(1)])
                    left = left[~found]
                    if not len(left):
                        break
                node = pa.array(np.concatenate(node))
                if len(node):
                    yield pa.RecordBatch.from_arrays([batch.column("plant_id").take(pa.array(np.full(len(node), k))), rows.field(1).take(node), pa.array(np.concatenate(radius))], [*NODE, "radius"])

    return packed.mapInArrow(run, f"{', '.join(f'{c} {dict(dt.dtypes)[c]}' for c in NODE)}, radius double")


def conductance(dt: DataFrame, radius: DataFrame, beta: float = 2.0, least: float = 0.01) -> DataFrame:
    """plant_id, node_id, gamma: least + (1 - least) * ((dt - 1) / (radius - 1))^beta; 1 where the radius is 1."""
    r = F.when(F.col("radius") == 1, F.lit(1.0)).otherwise((F.col("dt") - 1) / (F.col("radius") - 1))
    return dt.join(radius.hint("merge"), NODE).select(*NODE, (least + (1 - least) * F.pow(r, F.lit(beta))).alias("gamma"))


def travel_times(e: DataFrame, gamma: DataFrame) -> DataFrame:
    """Edges with w: length over the mean conductance of the ends."""
    u = gamma.select("plant_id", F.col("node_id").alias("u"), F.col("gamma").alias("gu"))
    v = gamma.select("plant_id", F.col("node_id").alias("v"), F.col("gamma").alias("gv"))
    return e.join(u.hint("merge"), ["plant_id", "u"]).join(v.hint("merge"), ["plant_id", "v"]).select("plant_id", "u", "v", "d", (F.col("d") / ((F.col("gu") + F.col("gv")) / 2)).alias("w"))


def reweighted(e: DataFrame, dt: DataFrame, radius: DataFrame, beta: float, least: float) -> DataFrame:
    """Stored edges with the travel times of other conductance parameters."""
    return travel_times(e.select("plant_id", "u", "v", "d"), conductance(dt, radius, beta, least))


def root(dt: DataFrame) -> DataFrame:
    """plant_id, node_id: the deepest voxel of the lowest slice."""
    best = dt.groupBy("plant_id").agg(F.min(F.struct("k", (-F.col("dt")).alias("d"), "node_id")).alias("b"))
    return best.select("plant_id", F.col("b.node_id").alias("node_id"))


def _block(node: str, block: int) -> Column:
    """Node ids follow (k, j, i), so a block of ids is a stretch of slices, or a part of one slice of a thick plant."""
    return F.floor(F.col(node) / block).cast("long")


LABEL = "nodes array<long>, dist array<double>, src array<long>, prev array<long>"
OFFERS = "o_block array<long>, o_node array<long>, o_dist array<double>, o_src array<long>, o_prev array<long>"


def _relaxed(row: object, block: int, max_dist: float) -> tuple[list, ...]:
    """One block's labels after the offers in its inbox have gone through it, and the offers that it makes to other blocks."""
    u = np.zeros(0, np.int64) if row.u is None else np.asarray(row.u)
    order = np.argsort(u, kind="stable")
    starts, ends = {}, {}
    if len(u):
        u, v, c = u[order], np.asarray(row.v)[order].tolist(), np.asarray(row.c)[order].tolist()
        own, first = np.unique(u, return_index=True)
        starts = dict(zip(own.tolist(), first.tolist(), strict=True))
        ends = dict(zip(own.tolist(), [*first[1:].tolist(), len(u)], strict=True))
    label = {} if row.nodes is None else {n: x for n, *x in zip(row.nodes.tolist(), row.dist.tolist(), row.src.tolist(), row.prev.tolist(), strict=True)}
    heap: list[tuple[float, int, int]] = []
    offers: dict[int, list] = {}

    def offer(n: int, d: float, s: int, p: int) -> None:
        known = label.get(n)
        if known is None or (d, s) < (known[0], known[1]):
            label[n] = [d, s, p]
            heapq.heappush(heap, (d, s, n))
        elif (d, s) == (known[0], known[1]) and known[2] >= 0 and p < known[2]:
            known[2] = p

    for m in row.inbox:
        offer(m["node"], m["dist"], m["src"], m["prev"])
    while heap:
        d, s, n = heapq.heappop(heap)
        if (d, s) != (label[n][0], label[n][1]):
            continue
        for k in range(starts.get(n, 0), ends.get(n, 0)):
            far, m = d + c[k], v[k]
            if far > max_dist:
                continue
            if m // block == row.block:
                offer(m, far, s, n)
            elif m not in offers or [far, s, n] < offers[m]:
                offers[m] = [far, s, n]
    flat = lambda rows, k: [x[k] for x in rows.values()]
    return [*label], *(flat(label, k) for k in range(3)), [m // block for m in offers], [*offers], *(flat(offers, k) for k in range(3))


def shortest_paths(e: DataFrame, sources: DataFrame, weight: str = "d", max_dist: float | None = None, targets: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """plant_id, node_id, dist, prev, nearest_source: distances from the nearest of a plant's sources (plant_id, node_id).

    A block of `block` node ids is one row with its arcs. In a round, each block that other blocks made offers to searches
    them through inside, best first, and makes offers across its border; so the rounds are as many as the blocks that a way
    crosses, not its steps, and settled blocks rest. With max_dist, or targets (plant_id, node_id), nothing farther than
    that, or than the plant's farthest target, is kept. Of equal ways the one with the smaller source wins, then the one
    with the smaller previous node.
    """
    kind, bound = e.schema["plant_id"].dataType.simpleString(), float("inf") if max_dist is None else float(max_dist)
    key = ["plant_id", "block"]
    arcs = both_ways(e.select("plant_id", "u", "v", F.col(weight).cast("double").alias("c")))
    arcs = arcs.groupBy("plant_id", _block("u", block).alias("block")).agg(F.collect_list(F.struct("u", "v", "c")).alias("a"))
    arcs = cut(arcs.select(*key, F.col("a.u").alias("u"), F.col("a.v").alias("v"), F.col("a.c").alias("c")))
    node = F.col("node_id").cast("long")
    mail = cut(sources.select("plant_id", _block("node_id", block).alias("block"), node.alias("node"), F.lit(0.0).alias("dist"), node.alias("src"), F.lit(-1).cast("long").alias("prev")).distinct())
    state = arcs.sparkSession.createDataFrame([], f"plant_id {kind}, block long, {LABEL}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                done = _relaxed(row, block, bound)
                yield pd.DataFrame([[row.plant_id, row.block, *done]], columns=[*key, "nodes", "dist", "src", "prev", "o_block", "o_node", "o_dist", "o_src", "o_prev"])

    while not mail.isEmpty():
        inbox = mail.groupBy(*key).agg(F.collect_list(F.struct("node", "dist", "src", "prev")).alias("inbox"))
        active = inbox.join(state, key, "left").join(arcs, key, "left")
        new = cut(active.mapInPandas(run, f"plant_id {kind}, block long, {LABEL}, {OFFERS}"))
        state = cut(state.join(new.select(*key), key, "left_anti").unionByName(new.select(*key, "nodes", "dist", "src", "prev")))
        sent = new.select("plant_id", F.explode(F.arrays_zip("o_block", "o_node", "o_dist", "o_src", "o_prev")).alias("o"))
        mail = sent.select("plant_id", F.col("o.o_block").alias("block"), F.col("o.o_node").alias("node"), F.col("o.o_dist").alias("dist"), F.col("o.o_src").alias("src"), F.col("o.o_prev").alias("prev"))
        if targets is not None:
            mail = mail.join(_farthest(_labels(state), targets), "plant_id", "left").where(F.col("far").isNull() | (F.col("dist") <= F.col("far"))).drop("far")
        mail = cut(mail)
    out = _labels(state)
    if targets is not None:
        out = out.join(_farthest(out, targets), "plant_id", "left").where(F.col("far").isNull() | (F.col("dist") <= F.col("far"))).drop("far")
    return out


def _labels(state: DataFrame) -> DataFrame:
    rows = state.select("plant_id", F.explode(F.arrays_zip("nodes", "dist", "src", "prev")).alias("x"))
    return rows.select("plant_id", F.col("x.nodes").alias("node_id"), F.col("x.dist").alias("dist"), F.when(F.col("x.prev") >= 0, F.col("x.prev")).alias("prev"), F.col("x.src").alias("nearest_source"))


def _farthest(found: DataFrame, targets: DataFrame) -> DataFrame:
    """plant_id, far: the distance of a plant's farthest target, once all its targets are reached."""
    met = targets.select("plant_id", "node_id").distinct().join(found.select(*NODE, "dist"), NODE, "left")
    return met.groupBy("plant_id").agg(F.max("dist").alias("far"), F.count(F.when(F.col("dist").isNull(), 1)).alias("open")).where("open = 0").drop("open")


def pointer_roots(pointers: DataFrame, most: int = 40) -> DataFrame:
    """plant_id, node_id, top, hops for pointers(plant_id, node_id, next): where following them ends, by doubling."""
    now = cut(pointers.select("plant_id", "node_id", F.col("next").alias("top"), F.when(F.col("next") == F.col("node_id"), 0).otherwise(1).cast("long").alias("hops")))
    for _ in range(most):
        further = now.select("plant_id", F.col("node_id").alias("top"), F.col("top").alias("t2"), F.col("hops").alias("h2"))
        step = cut(now.join(further, ["plant_id", "top"]).select("plant_id", "node_id", F.col("top").alias("old"), F.col("t2").alias("top"), (F.col("hops") + F.col("h2")).alias("hops")))
        now = step.select("plant_id", "node_id", "top", "hops")
        if not step.where("old <> top").limit(1).count():
            return now
    raise RuntimeError("pointers have not settled")


def extract_paths(sp: DataFrame, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """plant_id, tip, seq, node_id: the way from each start (plant_id, node_id) back to its source, the start first.

    The previous nodes lie in blocks of ids, as in `shortest_paths`; in a round each way goes as far as its block has it,
    so only the ways of the starts move. Starts that sp does not have give no row.
    """
    kind, key = sp.schema["plant_id"].dataType.simpleString(), ["plant_id", "block"]
    rows = sp.groupBy("plant_id", _block("node_id", block).alias("block")).agg(F.collect_list(F.struct("node_id", F.coalesce("prev", F.lit(-1)).alias("prev"))).alias("a"))
    rows = cut(rows.select(*key, F.col("a.node_id").alias("nodes"), F.col("a.prev").alias("prev")))
    node = F.col("node_id").cast("long")
    asked = cut(starts.select("plant_id", _block("node_id", block).alias("block"), node.alias("tip"), node.alias("at"), F.lit(0).cast("long").alias("seq")).distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                prev, out = dict(zip(row.nodes.tolist(), row.prev.tolist(), strict=True)), []
                for a in row.asked:
                    at, part = a["at"], []
                    while at in prev:
                        part.append(at)
                        at = prev[at]
                    if part:
                        out.append([row.plant_id, a["tip"], a["seq"], part, at])
                yield pd.DataFrame(out, columns=["plant_id", "tip", "seq", "part", "at"])

    parts = None
    while not asked.isEmpty():
        inbox = asked.groupBy(*key).agg(F.collect_list(F.struct("tip", "at", "seq")).alias("asked"))
        new = cut(inbox.join(rows, key).mapInPandas(run, f"plant_id {kind}, tip long, seq long, part array<long>, at long"))
        parts = new if parts is None else parts.union(new)
        asked = cut(new.where("at >= 0").select("plant_id", _block("at", block).alias("block"), "tip", "at", (F.col("seq") + F.size("part")).alias("seq")))
    if parts is None:
        return starts.select("plant_id", node.alias("tip"), F.lit(0).cast("long").alias("seq"), node.alias("node_id")).limit(0)
    spread = parts.select("plant_id", "tip", "seq", F.posexplode("part").alias("k", "node_id"))
    return spread.select("plant_id", "tip", (F.col("seq") + F.col("k")).alias("seq"), "node_id")


def ascent(nodes_u: DataFrame, e: DataFrame) -> DataFrame:
    """plant_id, node_id, next: the best of a node and its neighbours by (u descending, node id)."""
    there = nodes_u.select("plant_id", F.col("node_id").alias("v"), F.struct((-F.col("u")).alias("h"), F.col("node_id").alias("id")).alias("s"))
    near = both_ways(e.select("plant_id", "u", "v")).join(there, ["plant_id", "v"]).groupBy("plant_id", F.col("u").alias("node_id")).agg(F.min("s").alias("s"))
    own = F.struct((-F.col("u")).alias("h"), F.col("node_id").alias("id"))
    return nodes_u.join(near, NODE, "left").select(*NODE, F.least(own, F.coalesce("s", own))["id"].alias("next"))


def local_maxima(nodes_u: DataFrame, e: DataFrame) -> DataFrame:
    """The nodes with no higher neighbour; of equals the smaller id is the higher."""
    return ascent(nodes_u, e).where("next = node_id").select(*NODE)


def ascents(nodes_u: DataFrame, e: DataFrame) -> DataFrame:
    """plant_id, node_id, peak: where steepest ascent ends."""
    return pointer_roots(ascent(nodes_u, e)).select(*NODE, F.col("top").alias("peak"))


def snap_to_centre(dt: DataFrame, e: DataFrame, starts: DataFrame) -> DataFrame:
    """starts with `centre`: the end of steepest ascent of dt."""
    tops = ascents(dt.select(*NODE, F.col("dt").alias("u")), e)
    return starts.join(tops, NODE).select(*NODE, F.col("peak").alias("centre"))


def _turn() -> Column:
    """A node's turn in the sweep from high to low; of equals the smaller id comes first."""
    return F.struct((-F.col("u")).alias("h"), F.col("node_id").alias("id"))


def passes(nodes_u: DataFrame, climbs: DataFrame, e: DataFrame) -> DataFrame:
    """plant_id, a, b, pass: for each pair of adjacent ascent areas (a < b) the turn of the first swept node that joins them."""
    placed = climbs.join(nodes_u, NODE).select(*NODE, "peak", _turn().alias("t"))
    u = placed.select("plant_id", F.col("node_id").alias("u"), F.col("peak").alias("pu"), F.col("t").alias("tu"))
    v = placed.select("plant_id", F.col("node_id").alias("v"), F.col("peak").alias("pv"), F.col("t").alias("tv"))
    cross = e.select("plant_id", "u", "v").join(u, ["plant_id", "u"]).join(v, ["plant_id", "v"]).where("pu <> pv")
    return cross.groupBy("plant_id", F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b")).agg(F.min(F.greatest("tu", "tv")).alias("pass"))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The join tree of one plant's ascent areas: peaks (no b), and the passes between them."""
    own, links = rows[rows.b.isna()], rows[rows.b.notna()].sort_values(["h", "id", "a", "b"])
    height = dict(zip(own.a, own.h, strict=True))
    top, out = {p: p for p in height}, {p: (float("inf"), None, None, None) for p in height}

    def find(p: int) -> int:
        while top[p] != p:
            top[p] = top[top[p]]
            p = top[p]
        return p

    for (h, at), met in links.groupby(["h", "id"], sort=True):
        # All that a node joins meet at once: the highest stays and is the parent of the others.
        roots = sorted({find(int(p)) for p in [*met.a, *met.b]}, key=lambda p: (height[p], p))
        for low in roots[1:]:
            out[low], top[low] = (h - height[low], int(at), -h, roots[0]), roots[0]
    number = lambda k: pd.array([out[p][k] for p in height], dtype="Int64")
    return pd.DataFrame({"plant_id": rows.plant_id.iloc[0], "peak": list(height), "u": [-h for h in height.values()], "prominence": [out[p][0] for p in height], "saddle_node": number(1), "saddle_val": pd.array([out[p][2] for p in height], dtype="Float64"), "parent": number(3)})


def prominences(nodes_u: DataFrame, e: DataFrame, climbs: DataFrame | None = None) -> DataFrame:
    """The peaks of the join tree of a field u on each plant's graph: plant_id, peak, u, prominence, saddle_node, saddle_val, parent.

    The sweep from high to low joins components at saddles, where all peaks but the highest die; the highest of a connected
    part never does (infinite prominence). Ascents and passes are found in parallel; only the passes between ascent areas, a
    small table next to the nodes, meet by plant.
    """
    climbs = cut(ascents(nodes_u, e)) if climbs is None else climbs
    met = passes(nodes_u, climbs, e)
    tops = climbs.where("peak = node_id").join(nodes_u, NODE).select("plant_id", F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"), (-F.col("u")).alias("h"), F.lit(None).cast("long").alias("id"))
    rows = tops.union(met.select("plant_id", "a", "b", "pass.h", "pass.id"))
    kind = nodes_u.schema["plant_id"].dataType.simpleString()
    return rows.groupBy("plant_id").applyInPandas(_merged, f"plant_id {kind}, peak long, u double, prominence double, saddle_node long, saddle_val double, parent long")


def join_tree(nodes_u: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The peaks as `prominences` gives them, and labels(plant_id, node_id, peak): the highest peak of the component that a node is in when it is swept.

    Labels climb the tree from the end of their ascent by jumps of halving length.
    """
    climbs = cut(ascents(nodes_u, e))
    peaks = cut(prominences(nodes_u, e, climbs))
    ends = F.struct((-F.col("saddle_val")).alias("h"), F.col("saddle_node").alias("id"))
    jumps = [cut(peaks.where("parent is not null").select("plant_id", "peak", F.col("parent").alias("to"), ends.alias("end")))]
    while True:
        last = jumps[-1]
        then = last.select("plant_id", F.col("peak").alias("to"), F.col("to").alias("to2"), F.col("end").alias("end2"))
        longer = cut(last.join(then, ["plant_id", "to"]).select("plant_id", "peak", F.col("to2").alias("to"), F.col("end2").alias("end")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    at = climbs.join(nodes_u, NODE).select(*NODE, "peak", _turn().alias("t"))
    for jump in reversed(jumps):
        at = at.join(jump, ["plant_id", "peak"], "left").select(*NODE, F.when(F.col("end") <= F.col("t"), F.col("to")).otherwise(F.col("peak")).alias("peak"), "t")
    return peaks, at.select(*NODE, "peak")


def basins(nodes_u: DataFrame, e: DataFrame) -> DataFrame:
    """plant_id, node_id, peak: the labels of the join tree."""
    return join_tree(nodes_u, e)[1]


def prominent_maxima(peaks: DataFrame, h: float) -> DataFrame:
    """Peaks of at least this prominence, ranked from the most prominent down."""
    w = Window.partitionBy("plant_id").orderBy(F.desc("prominence"), "peak")
    return peaks.where(F.col("prominence") >= h).withColumn("rank", F.row_number().over(w))


def far_from_top(tips: DataFrame, e: DataFrame, top: DataFrame, h: float) -> DataFrame:
    """Tips at least h voxel steps of length away from the stem's top."""
    near = shortest_paths(e, top, "d", h).where(F.col("dist") < h)
    return tips.join(near, NODE, "left_anti")
