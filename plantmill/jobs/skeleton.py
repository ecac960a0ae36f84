"""From occupied voxels to the stem and the fruit branches of every plant, in one job over all plants."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantmill.operators import graph
from plantmill.operators.components import cut, keep_largest
from plantmill.operators.results import keep_options, upsert

NODE = graph.NODE


@dataclass(frozen=True)
class Params:
    # Conductance exponent and floor, prominence in voxel steps, least voxels of a truncated tip.
    beta: float = 2.0
    nu_min: float = 0.01
    h: float = 15.0
    least: int = 3


@dataclass
class Skeleton:
    nodes: DataFrame  # plant_id, node_id, i, j, k, dt, radius
    edges: DataFrame  # plant_id, u, v, d, w
    root: DataFrame
    top: DataFrame
    tips: DataFrame  # fruit tips: plant_id, node_id, stem_target, waypoints
    stem: DataFrame  # plant_id, seq, node_id from root to top
    branches: DataFrame  # plant_id, tip, seq, node_id from stem to tip
    dist: DataFrame  # plant_id, node_id, dist: lengths from the root
    peaks: DataFrame  # the join tree of dist
    faces: DataFrame  # where the plant leaves the box


def build_graph(occupied: DataFrame, dims: tuple[int, int, int], params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Nodes with dt and radius, and edges with length d and travel time w, of each plant's largest component: debris is dropped."""
    nodes = cut(graph.node_ids(keep_largest(occupied, ["plant_id"], graph.AXES)))
    dt = cut(graph.distance_transform(nodes, dims))
    radius = cut(graph.local_radius(dt))
    gamma = graph.conductance(dt, radius, params.beta, params.nu_min)
    return cut(dt.join(radius, NODE)), cut(graph.travel_times(graph.edges(nodes), gamma))


def empty_plants(plants: DataFrame, occupied: DataFrame) -> DataFrame:
    """plant_id, reason: the plants(plant_id) that have no occupied voxel, so no skeleton; the others go on without them."""
    lost = plants.select("plant_id").distinct().join(occupied.select("plant_id").distinct(), "plant_id", "left_anti")
    return lost.select("plant_id", F.lit("no voxel above the threshold").alias("reason"))


def stem_top(maxima: DataFrame, truncated: DataFrame, dt: DataFrame, dist: DataFrame) -> DataFrame:
    """plant_id, node_id: the deepest tip on the top face; else the farthest local maximum; else the farthest truncated tip."""
    cut_tips = truncated.join(dt.select(*NODE, "dt"), NODE).join(dist.select(*NODE, "dist"), NODE)
    far = lambda rank, rows: rows.select("plant_id", "node_id", F.lit(rank).alias("rank"), (-F.col("dist")).alias("key"))
    first = cut_tips.where("face = 'k1'").select("plant_id", "node_id", F.lit(0).alias("rank"), (-F.col("dt")).alias("key"))
    every = first.union(far(1, maxima.join(dist.select(*NODE, "dist"), NODE))).union(far(2, cut_tips))
    return every.groupBy("plant_id").agg(F.min(F.struct("rank", "key", "node_id")).alias("b")).select("plant_id", F.col("b.node_id").alias("node_id"))


def paths_from(e: DataFrame, sources: DataFrame, ends: DataFrame) -> DataFrame:
    """plant_id, tip, seq, node_id: the fastest ways to the ends, listed from their sources."""
    ways = cut(graph.extract_paths(graph.shortest_paths(e, sources, "w"), ends))
    last = ways.groupBy("plant_id", "tip").agg(F.max("seq").alias("last"))
    return ways.join(last, ["plant_id", "tip"]).select("plant_id", "tip", (F.col("last") - F.col("seq")).alias("seq"), "node_id")


def branch_paths(e: DataFrame, stem: DataFrame, tips: DataFrame) -> DataFrame:
    """plant_id, tip, seq, node_id from stem to tip, for tips(plant_id, node_id, stem_target, waypoints).

    The way goes from the stem target, or any stem node where none is given, through the waypoints in their order. Each leg is
    a search between two nodes: legs of all tips that leave a plant's k-th pair of ends run together, and a node that two legs share is listed once.
    """
    stops = tips.select("plant_id", F.col("node_id").alias("tip"), "stem_target", F.concat(F.coalesce("waypoints", F.array().cast("array<long>")), F.array(F.col("node_id").cast("long"))).alias("stops"))
    legs = stops.select("plant_id", "tip", "stem_target", "stops", F.posexplode("stops").alias("leg", "to"))
    start = F.when(F.col("leg") > 0, F.get("stops", F.col("leg") - 1)).otherwise(F.col("stem_target"))
    legs = cut(legs.select("plant_id", "tip", "leg", start.alias("start"), "to"))
    free = paths_from(e, stem.select(*NODE), legs.where("start is null").select("plant_id", F.col("to").alias("node_id")).distinct())
    found = free.withColumnRenamed("tip", "to").join(legs.where("start is null"), ["plant_id", "to"]).select("plant_id", "tip", "leg", "seq", "node_id")
    # Each start is a search of its own: a round takes the first start of every plant that is still open.
    tied = cut(legs.where("start is not null"))
    while not tied.isEmpty():
        one = cut(tied.groupBy("plant_id").agg(F.min("start").alias("start")))
        now = cut(tied.join(one, ["plant_id", "start"], "left_semi"))
        ends = now.select("plant_id", F.col("to").alias("node_id")).distinct()
        sp = graph.shortest_paths(e, one.select("plant_id", F.col("start").alias("node_id")), "w", targets=ends)
        ways = cut(graph.extract_paths(sp, ends)).withColumnRenamed("tip", "to")
        last = ways.groupBy("plant_id", "to").agg(F.max("seq").alias("last"))
        ways = ways.join(last, ["plant_id", "to"]).withColumn("seq", F.col("last") - F.col("seq"))
        found = cut(found.unionByName(ways.join(now, ["plant_id", "to"]).select("plant_id", "tip", "leg", "seq", "node_id")))
        tied = cut(tied.join(one, ["plant_id", "start"], "left_anti"))
    order = Window.partitionBy("plant_id", "tip").orderBy("leg", "seq")
    kept = found.where("leg = 0 or seq > 0")
    return kept.select("plant_id", "tip", (F.row_number().over(order) - 1).alias("seq"), "node_id")


OPTIONS = {"stem_target": "long", "waypoints": "array<long>"}


def with_options(tips: DataFrame) -> DataFrame:
    """tips(plant_id, node_id) with stem_target and waypoints, null where they lack them."""
    return tips.select(*NODE, *(F.col(c) if c in tips.columns else F.lit(None).cast(k).alias(c) for c, k in OPTIONS.items()))


def _candidates(dt: DataFrame, peaks: DataFrame, faces: DataFrame, h: float) -> tuple[DataFrame, DataFrame]:
    """Peaks of enough prominence that do not touch the box, and the tips where a plant leaves the box other than below."""
    high = graph.prominent_maxima(peaks, h).select("plant_id", F.col("peak").alias("node_id"))
    maxima = cut(high.join(faces.select(*NODE).distinct(), NODE, "left_anti"))
    return maxima, cut(graph.truncated_tips(faces, dt))


def _fruit_tips(maxima: DataFrame, truncated: DataFrame, dist: DataFrame, e: DataFrame, root: DataFrame, top: DataFrame, h: float) -> DataFrame:
    found = maxima.select(*NODE).union(truncated.select(*NODE)).distinct().join(dist.select(*NODE), NODE, "left_semi")
    return graph.far_from_top(found.join(root, NODE, "left_anti"), e, top, h)


def _attached(base: Skeleton, top: DataFrame, tips: DataFrame) -> Skeleton:
    """The skeleton of the same graph with this top and these tips: stem and branches anew."""
    tips = cut(with_options(tips))
    stem = cut(paths_from(base.edges, base.root, top).select("plant_id", "seq", "node_id"))
    return replace(base, top=top, tips=tips, stem=stem, branches=cut(branch_paths(base.edges, stem, tips)))


def skeleton(occupied: DataFrame, dims: tuple[int, int, int], params: Params = Params(), roots: DataFrame | None = None, tops: DataFrame | None = None, tips: DataFrame | None = None) -> Skeleton:
    """The skeleton of every plant; roots, tops and tips given by hand (plant_id, node_id, and for tips stem_target and waypoints) replace what is found.

    Distances from the root have a maximum at every tip: those of enough prominence that do not touch the box, and the
    deepest voxel of each place where the plant leaves the box other than below, are tips. The stem is the fastest way
    from root to top; tips within h of the top go; each other tip's branch is the fastest way to it from any stem node.
    """
    dt, e = build_graph(occupied, dims, params)
    return _rooted(dt, e, dims, params, roots, tops, tips)


def _rooted(dt: DataFrame, e: DataFrame, dims: tuple[int, int, int], params: Params, roots: DataFrame | None, tops: DataFrame | None, tips: DataFrame | None) -> Skeleton:
    root = graph.root(dt)
    root = cut(root if roots is None else upsert(root, roots.select(*NODE), ["plant_id"]))
    dist = cut(graph.shortest_paths(e, root, "d"))
    field = dist.select("plant_id", "node_id", F.col("dist").alias("u"))
    joined = e.join(field.select("plant_id", F.col("node_id").alias("u")), ["plant_id", "u"], "left_semi")
    peaks = cut(graph.prominences(field, joined))
    faces = cut(graph.truncation(dt.select(*NODE, *graph.AXES), dims, params.least))
    maxima, truncated = _candidates(dt, peaks, faces, params.h)
    top = stem_top(maxima, truncated, dt, dist)
    top = cut(top if tops is None else upsert(top, tops.select(*NODE), ["plant_id"]))
    found = with_options(_fruit_tips(maxima, truncated, dist, e, root, top, params.h))
    found = found if tips is None else upsert(found, with_options(tips), ["plant_id"])
    return _attached(Skeleton(dt, e, root, top, found, found, found, dist, peaks, faces), top, found)


def move_root(sk: Skeleton, roots: DataFrame, dims: tuple[int, int, int], params: Params = Params()) -> Skeleton:
    """Other roots: tips are detected anew, tops stay, everything else follows."""
    new = upsert(sk.root, roots.select(*NODE), ["plant_id"])
    return _rooted(sk.nodes, sk.edges, dims, params, new, sk.top, None)


def move_top(sk: Skeleton, tops: DataFrame, params: Params = Params()) -> Skeleton:
    """Other tops: the tips near one go, the others stay with their options, stem and branches follow."""
    top = cut(upsert(sk.top, tops.select(*NODE), ["plant_id"]))
    return _attached(sk, top, graph.far_from_top(sk.tips, sk.edges, top, params.h))


def change_prominence(sk: Skeleton, h: float) -> Skeleton:
    """Another prominence: the stored peaks are filtered again; tips of the same node keep their options, the stem stays."""
    maxima, truncated = _candidates(sk.nodes, sk.peaks, sk.faces, h)
    found = _fruit_tips(maxima, truncated, sk.dist, sk.edges, sk.root, sk.top, h)
    tips = cut(retune_tips(found, sk.tips))
    return replace(sk, tips=tips, branches=cut(branch_paths(sk.edges, sk.stem, tips)))


def change_threshold(sk: Skeleton, occupied: DataFrame, dims: tuple[int, int, int], params: Params = Params()) -> Skeleton:
    """The voxels of another threshold: everything anew, but tips of the same node keep their options."""
    new = skeleton(occupied, dims, params)
    tips = cut(retune_tips(new.tips, sk.tips))
    return replace(new, tips=tips, branches=cut(branch_paths(new.edges, new.stem, tips)))


def change_conductance(sk: Skeleton, params: Params) -> Skeleton:
    """Other conductance parameters: travel times on the stored edges and radii; tops and tips stay."""
    e = cut(graph.reweighted(sk.edges, sk.nodes.drop("radius"), sk.nodes.select(*NODE, "radius"), params.beta, params.nu_min))
    return _attached(replace(sk, edges=e), sk.top, sk.tips)


def change_tips(sk: Skeleton, tips: DataFrame) -> Skeleton:
    """The tips that `results.upsert`, `remove` or `replace_plants` made: only branches follow."""
    tips = cut(with_options(tips))
    return replace(sk, tips=tips, branches=cut(branch_paths(sk.edges, sk.stem, tips)))


def retune_tips(found: DataFrame, old: DataFrame) -> DataFrame:
    """Tips found anew, with the options that tips of the same node had."""
    return keep_options(with_options(found), with_options(old), NODE, list(OPTIONS))


def saved_state(sk: Skeleton) -> DataFrame:
    """plant_id, stem_root, stem_top, branch_tips: what rebuilds a skeleton."""
    tips = sk.tips.groupBy("plant_id").agg(F.array_sort(F.collect_list(F.struct("node_id", *OPTIONS))).alias("branch_tips"))
    ends = sk.root.select("plant_id", F.col("node_id").alias("stem_root")).join(sk.top.select("plant_id", F.col("node_id").alias("stem_top")), "plant_id", "left")
    return ends.join(tips, "plant_id", "left")


def reopened(occupied: DataFrame, dims: tuple[int, int, int], saved: DataFrame, full: bool, params: Params = Params()) -> Skeleton:
    """The skeletons of saved(plant_id, stem_root, stem_top, branch_tips, complete): plants of the other kind of run, or without a row, are built anew.

    `complete` says that a row comes from a run from images; `full` asks for those, else for runs from external voxels.
    """
    own = cut(saved.where(F.col("complete") if full else ~F.col("complete")))
    node = lambda c: own.where(F.col(c).isNotNull()).select("plant_id", F.col(c).alias("node_id"))
    tips = own.select("plant_id", F.inline("branch_tips"))
    return skeleton(occupied, dims, params, node("stem_root"), node("stem_top"), tips)
