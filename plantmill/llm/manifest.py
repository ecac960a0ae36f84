"""Merkle manifest of a table: a hash of all rows, and for each row a proof that it belongs to it.

Each row's fields are hashed to a leaf where they are read; only digests move. Per source the leaves, by doc_id, are
dealt into aligned blocks of `WIDTH` ** `LEVELS`, so a source with a third of all rows is many blocks. Their tops are the
leaves of the next layer, up to one node a source; the sources' subroots make the last tree in the same way.

Paths are made by traversal (`paths`): a block's task goes through its leaves in order, holds for each level the run of
nodes that the leaf's path crosses, and builds the next run with a treehash stack a level. The stack with the lowest tail
goes first, so what is held besides the leaves stays a few digests a level. The path above the block is the same for all of
its leaves and is appended; it comes down the layers by joins of one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmill.llm.common import cut

WIDTH, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(text: Column) -> Column:
    """The digest of a row: each field as `-` if null, else its UTF-8 byte count, a colon and the value."""
    shown = [(text if c == "text" else F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, from 0 by `order` within the group, and the group's size n.

    Rows are sorted by ranges over all tasks and kept so; a group's rows are counted by range, and a row's place is its
    range's offset plus its place in it. No task ever holds a whole group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    runs = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return dealt.join(runs, [group, "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """One node of a level, built from its leaves first to last with a stack of finished nodes."""

    def __init__(self, values: list[str], level: int, number: int) -> None:
        self.values, self.level, span = values, level, WIDTH**level
        self.at, self.end = number * span, min((number + 1) * span, len(values))
        self.stack: list[tuple[int, str]] = []

    def tail(self) -> int:
        """The level of the lowest finished node; that of the whole node before any leaf."""
        return self.stack[-1][0] if self.stack else self.level

    def update(self) -> bool:
        """Takes one leaf; True when the node is done."""
        self.stack.append((0, self.values[self.at]))
        self.at += 1
        while (low := self.stack[-1][0]) < self.level:
            run = [h for k, h in self.stack[-WIDTH:] if k == low]
            if len(run) < WIDTH and self.at < self.end:
                break
            self.stack[-len(run) :] = [(low + 1, _joined(run))]
        return self.at == self.end

    def node(self) -> str:
        while self.at < self.end:
            self.update()
        return self.stack[0][1]


class Level:
    """The run of nodes that the current leaf's path crosses, and the next run in the making."""

    def __init__(self, values: list[str], level: int) -> None:
        self.values, self.level, self.count = values, level, -(-len(values) // WIDTH**level)
        self.run = [Treehash(values, level, k).node() for k in range(min(WIDTH, self.count))]
        self.begin(WIDTH)

    def begin(self, first: int) -> None:
        self.ahead: list[str] = []
        self.number, self.last = first, min(first + WIDTH, self.count)
        self.hash = Treehash(self.values, self.level, first) if first < self.last else None

    def update(self) -> None:
        if self.hash.update():
            self.ahead.append(self.hash.node())
            self.number += 1
            self.hash = Treehash(self.values, self.level, self.number) if self.number < self.last else None

    def enter(self, first: int) -> None:
        """The path crosses the run from `first` on: the one ahead becomes the current one."""
        while self.hash:
            self.update()
        self.run = self.ahead
        self.begin(first + WIDTH)

    def held(self) -> int:
        return len(self.run) + len(self.ahead) + (len(self.hash.stack) if self.hash else 0)


def paths(values: list[str], levels: int, seen: list[int] | None = None) -> Iterator[list[dict[str, str]]]:
    """The path of each value in turn to the node `levels` above; `seen` collects the digests held at each step."""
    state = [Level(values, k) for k in range(levels)]
    for p in range(len(values)):
        for level in state:
            span = WIDTH ** (level.level + 1)
            if p and p % span == 0:
                level.enter(p // span * WIDTH)
        if seen is not None:
            seen.append(sum(level.held() for level in state))
        out = []
        for level in state:
            own = p // WIDTH**level.level % WIDTH
            out.append({"left": "".join(level.run[:own]), "right": "".join(level.run[own + 1 :])})
        yield out
        for _ in range(levels):
            open_ = [level for level in state if level.hash]
            if open_:
                min(open_, key=lambda level: level.hash.tail()).update()


def _levels_left(height: Column, layer: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), height - layer * LEVELS)).cast("int")


def _tops(blocks: DataFrame) -> DataFrame:
    """key, pos, height, value: the node above each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Treehash(v, k, 0).node() for v, k in zip(b.column("value").to_pylist(), b.column("levels").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("block"), b.column("height"), pa.array(got, pa.string())], ["key", "pos", "height", "value"])

    arrays = blocks.select("key", "block", "height", "levels", F.col("nodes.value").alias("value"))
    return arrays.mapInArrow(run, "key string, pos long, height int, value string")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each layer of trees, up to one node a key. nodes(key, pos, n, value, item): item comes back with the path.

    A block is key, block, height, levels, nodes array<struct<pos, value, item>>, in order.
    """
    powers = F.array(*(F.lit(WIDTH**k) for k in range(40)))
    nodes = nodes.select("key", "pos", F.size(F.filter(powers, lambda p: p < F.col("n"))).alias("height"), "value", "item")
    highest = nodes.agg(F.max("height")).first()[0] or 0
    out: list[DataFrame] = []
    for layer in range(max(1, -(-highest // LEVELS))):
        if layer:
            nodes = _tops(out[-1]).withColumn("item", F.lit(None).cast("string"))
        dealt = nodes.groupBy("key", F.floor(F.col("pos") / F.lit(WIDTH**LEVELS)).cast("long").alias("block"), "height")
        blocks = dealt.agg(F.array_sort(F.collect_list(F.struct("pos", "value", "item"))).alias("nodes"))
        out.append(cut(blocks.withColumn("levels", _levels_left(F.col("height"), layer))))
    return out


def descend(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """key, pos, value, item, path for each node of the lowest layer, with `above`'s columns. above(key, path, ...): one row a key."""
    extra = [c for c in above.columns if c not in ("key", "path")]
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(layers):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for value, levels, row in zip(b.column("value").to_pylist(), b.column("levels").to_pylist(), range(b.num_rows), strict=True):
                    yield pa.RecordBatch.from_arrays([b.column("row").slice(row, 1), pa.array([list(paths(value, levels))], pa.list_(STEP))], ["row", "paths"])

        row = F.struct("key", F.transform("nodes", lambda x: F.struct(x["pos"], x["item"])).alias("nodes"), F.col("path").alias("rest"), *extra)
        met = blocks.join(upper, ["key", "block"]).select(row.alias("row"), "levels", F.col("nodes.value").alias("value"))
        kept = met.select("row").schema["row"].dataType.simpleString()
        walked = met.mapInArrow(run, f"row {kept}, paths array<{PATH}>")
        zipped = walked.select("row", F.explode(F.arrays_zip("row.nodes", "paths")).alias("x"))
        upper = zipped.select("row.key", F.col("x.nodes.pos").alias("block"), "x.nodes.item", F.concat("x.paths", "row.rest").alias("path"), *(f"row.{c}" for c in extra))
        if blocks is not layers[0]:
            upper = cut(upper.drop("item"))
    return upper.withColumnRenamed("block", "pos")


def roots(layers: list[DataFrame]) -> DataFrame:
    """key, value: the one node of each key."""
    return _tops(layers[-1]).select("key", "value")


def manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, leaf, offered, subroot, root, path: a row for each row of docs; docs(doc_id, source, lang, n_chars, text).

    `changed` is the text as offered for proof, over docs' columns; `offered` is its leaf, with the other fields as they are.
    A null field is hashed as `-`, null doc_ids come first, and null is a source of its own, before all others. Empty and very
    long texts are hashed whole. Rows of one doc_id are ordered by their leaves, so only equal rows are interchangeable, and
    each keeps its own leaf. Other columns are ignored, also those named like columns of the result; an empty table gives
    no row.
    """
    own = docs.select(*FIELDS, changed.alias("_changed"))
    same = F.col("_changed").eqNullSafe(F.col("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # sorts as source does, null first
    hashed = own.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("value"), F.when(~same, leaf(F.col("_changed"))).alias("offered"))
    placed = numbered(cut(hashed), "key", ["doc_id", "value"])
    layers = climb(placed.select("key", "pos", "n", "value", F.struct("doc_id", F.col("value").alias("leaf"), "offered").alias("item")))
    subroots = cut(roots(layers)).withColumnRenamed("key", "source_key")
    whole = numbered(subroots.withColumn("key", F.lit("")), "key", ["source_key"])
    sources = climb(whole.select("key", "pos", "n", "value", F.struct("source_key", F.col("value").alias("subroot")).alias("item")))
    top = roots(sources).select("key", F.array().cast(PATH).alias("path"), F.col("value").alias("root"))
    above = cut(descend(sources, top).select(F.col("item.source_key").alias("key"), "path", "item.subroot", "root"))
    done = descend(layers, above)
    return done.select("item.doc_id", "item.leaf", F.coalesce("item.offered", "item.leaf").alias("offered"), "subroot", "root", "path")


def without_newlines(docs_id: Column, text: Column) -> Column:
    """The text without its \\n characters where 2 divides the unsigned crc32 of the decimal doc_id."""
    return F.when(F.crc32(docs_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def audit(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, tried on the text as offered."""
    out = manifest(docs, changed).withColumn("folded_root", fold(F.col("offered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
