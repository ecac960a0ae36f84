"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most `THRESHOLD` = 2. The anchors are the
words of a covering code: the 64 bits are cut into blocks of one or three bits, and in each block an anchor is the
repetition word of the block's majority. Blocks of three have covering radius 1, so the code's radius is the number
of such blocks. Two fingerprints within 2 bits have a midpoint within 1 bit of both, and the midpoint lies within the
covering radius of its own anchor; so each fingerprint goes to the anchors of all words within 1 bit of itself (every
anchor that lies within radius plus threshold and can hold a partner), and two linked ones always meet at an anchor.
That takes 1 + (blocks of one bit) + (unequal blocks of three) copies of a fingerprint, 22 on average at 26 blocks.

The number of anchors follows the number of distinct fingerprints (`blocks_for`), so that an anchor holds a few of them at
any size of corpus; the result is the same for any code. Exact copies are one fingerprint before any of this. An
anchor with more than `DENSE` members (a large group of almost equal documents) is not compared pair by pair: its members
go on to the finest code, whose 2^64 anchors have radius 0. All members of such an anchor are within 1 bit of it, so
within 2 of each other, and one star of links says all that the pairs would say.

`keep_one` owes more: one document of each group whose sets of five-word shingles have a Jaccard similarity of `SIMILAR` = 0.8
or more. At 0.8 about 15 % of the bits of two fingerprints differ, 10 of 64, and a covering code for that needs thousands of
copies of each. So links of 2 bits are only its first candidates. The others come from prefixes: in any one order of all
shingles, two sets of n and m that are similar share one of the first n - ceil(0.8 n) + 1 of each, and more of them the closer
n and m are (`prefix_pairs`). No similar pair is left out, whatever the order is. The order puts shingles that many texts have
last (`frequent`), so that few texts meet by those; it decides how much work there is and nothing else. Pairs that links have
joined already are not compared.

A shingle that more than `CROWD` open texts have makes no pairs. Of those texts only the ones go on that share 0.8 of their whole
set with texts of other groups (`reachable`; no other can be similar to one), most of them with that share alone. Each goes to a
chunk of at most about `BLOCK` texts by its most crowded shingle; chunks that hold a crowded shingle in common meet once as two
rows of sets, and a task compares their texts by a product of 0/1 matrices. What leaves the task are the links that join groups, no more of them than there are texts.
A group of N texts that stay below the limit thus costs (N / `BLOCK`)^2 / 2 rows; its comparisons still grow with N^2.

A candidate is judged by sketches, the `SKETCH` smallest hashes of each set: they are the whole sets of texts of up to that
many shingles. What they leave open is compared by the whole sets: for those a similarity within `CLASHES` shingles of the limit
(equal 32-bit values of unlike hashes), for longer texts an estimate within nine standard deviations of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmill.llm.common import cut, dealt_join, new_folder, raw_texts

BITS, THRESHOLD, SEED = 64, 2, 42
DENSE = 64
SPAN, WHITE = 1 << 18, re.compile(rb"[\x20\x09-\x0D]")  # bytes of a text that are words at once
SIMILAR = 0.8
SKETCH, DEVIATIONS, CLASHES = 1024, 9.0, 4
FEW = 200_000  # row numbers that may be broadcast
CROWD, BLOCK, COLUMNS = 32, 256, 4096  # texts that meet pair by pair at a shingle; texts of a chunk; shingles that one matrix product takes
COUNTED, OFTEN, FREQUENT = 1 << 19, 8, 1 << 18  # shingles among which repeats are counted; repeats and number of the shingles that come last


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, some at a time, so that memory is bounded on very long texts."""
    words: list[bytes] = []
    at, any_yet = 0, False
    while at < len(text):
        stop = WHITE.search(text, at + SPAN)  # bytes: A-Z and ASCII white space only
        end = stop.start() if stop else len(text)
        words += text[at:end].lower().split()
        at = end
        if len(words) >= shingle:
            items = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
            yield np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in items), np.uint64, len(items))
            words, any_yet = words[len(words) - shingle + 1 :], True
    if words and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    value = int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer; 0 if it has no word."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp long: one row per document, read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in raw_texts(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def blocks_for(n: int) -> int:
    """Blocks of the code for n distinct fingerprints: about 256 anchors for each, so chance meetings stay as rare at any size."""
    k = max(22, min(BITS, int(n).bit_length() + 8))
    return k + (k % 2)  # 64 = ones + 3 * triples, so ones + triples is even


def anchors(fp: Column, blocks: int) -> Column:
    """The anchors of all words within 1 bit of fp, without repeats: array<long>."""
    triples = (BITS - blocks) // 2
    home, flips = None, []
    low = sum(1 << (3 * t) for t in range(triples))  # the lowest bit of each block of three
    if triples:
        a, b, c = fp, F.shiftrightunsigned(fp, 1), F.shiftrightunsigned(fp, 2)
        major = a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c)).bitwiseAND(F.lit(low))
        uneven = a.bitwiseXOR(b).bitwiseOR(a.bitwiseXOR(c)).bitwiseAND(F.lit(low))  # blocks that one flip can turn
        high = ((1 << 64) - 1) ^ ((1 << (3 * triples)) - 1)
        home = major.bitwiseOR(fp.bitwiseAND(F.lit(high - (1 << 64) if high >> 63 else high)))
        flips += [F.when(F.getbit(uneven, F.lit(3 * t)) == 1, home.bitwiseXOR(F.lit(1 << (3 * t)))) for t in range(triples)]
    home = fp if home is None else home
    flips += [home.bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0))) for k in range(3 * triples, BITS)]
    return F.array_compact(F.array(home, *flips))


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of `edges(u, v)`.

    Large-star and small-star rounds: joins and grouped minima only, never one node's neighbours in a task. The path
    to a root halves in each round; the driver sees one count a round.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        near = both(edges)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = cut(
            small.select(F.col("u"), F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("root")).union(new.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("root").alias("root")).where("own + root > 1")
        edges = new
        if open_.isEmpty():  # every node hangs on one root
            break
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def links(classes: DataFrame, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """u, v: links between `classes(fp, node)` at most THRESHOLD bits apart, enough of them for the same components."""
    blocks = blocks or blocks_for(classes.count())
    spread = classes.repartition("fp")  # few partitions before they grow
    placed = spread.select("node", "fp", F.explode(anchors(F.col("fp"), blocks)).alias("anchor"))
    met = cut(placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1"))  # one shuffle; few meet
    sparse = met.where(F.col("n") <= dense)
    a, b = sparse.alias("a"), sparse.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= THRESHOLD
    pairs = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.node") > F.col("b.node")) & near)
    pairs = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    members = met.where(F.col("n") > dense).select("node", "fp").distinct()
    fine = members.select("node", F.explode(anchors(F.col("fp"), BITS)).alias("anchor"))
    head = fine.groupBy("anchor").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = fine.join(head.select("anchor", "v"), "anchor").where("node <> v").select(F.col("node").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id, component_size: every document with the smallest doc_id that links reach from it.

    Null and empty texts, and texts without a word, have fingerprint 0, which is linked like any other. Repeated rows of
    one doc_id each keep a row, and so do rows of one doc_id with other texts, each with its own fingerprint's component. Rows with
    a null doc_id keep a row with a null component. Very long texts are read whole, some shingles at a time. Extra columns
    are ignored; an empty table gives no row.
    """
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = star_components(links(classes.select("fp", F.col("fp").alias("node")), dense, blocks))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("top"))
    total = named.groupBy("top").agg(F.sum("n").alias("component_size"), F.min("least").alias("component_id"))
    named = named.join(total, "top").select("fp", "component_id", "component_size")
    out = dealt_join(prints, named, "fp", "doc_id")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "fp", F.when(known, F.col("component_id")).alias("component_id"), F.when(known, F.col("component_size")).alias("component_size"))


MARKS = "row long, doc_id long, fp long, n int, print binary, often array<long>"


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The smallest `SKETCH` of a set's hashes, mixed and cut to 32 bits, in order."""
    mixed = np.unique((((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32))
    return mixed[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """The Jaccard similarity of two sets by their sketches, and how many values of the union tell it (0: all of them)."""
    tops = [x[-1] for x in (a, b) if len(x) == SKETCH]
    if tops:  # above the smaller top, not every value of both is known
        a, b = a[: np.searchsorted(a, min(tops), "right")], b[: np.searchsorted(b, min(tops), "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return (both / union if union else 1.0), (union if tops else 0)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def repeats(sets: Iterable[np.ndarray]) -> np.ndarray:
    """The hashes that several of the sets hold, each once less than sets hold it."""
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    every.sort()
    return every[1:][every[1:] == every[:-1]]


def marks(rows: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, fp, n and print (of the set of shingles): one row per row of rows(row, doc_id, text).

    Rows without a row number hold in `often` what repeats among some unlike texts that a task reads one after another.
    """

    def told(keys: list[pa.Array], fps: list[int | None], ns: list[int | None], prints: list[bytes | None], often: list[np.ndarray]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, often)]), pa.int32()), pa.array(np.concatenate(often).view(np.int64), pa.int64()))
        return pa.RecordBatch.from_arrays([*keys, pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(prints, pa.binary()), lists], ["row", "doc_id", "fp", "n", "print", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, null = np.zeros(0, np.uint64), pa.nulls(1, pa.int64())
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for keys, texts in raw_texts(batches, "key"):
            fps, ns, prints = [], [], []
            for t in texts:
                parts = list(shingle_hashes(t, shingle))
                own = np.unique(np.concatenate([none, *parts]))
                fps.append(fingerprint_of(parts))
                ns.append(len(own))
                prints.append(xxhash.xxh128_digest(own.tobytes()))
                held += 0 if prints[-1] in sets else len(own)
                sets[prints[-1]] = own
                if held >= COUNTED:
                    yield told([null, null], [None], [None], [None], [repeats(sets.values())])
                    sets, held = {}, 0
            if texts:
                yield told([keys.field(0), keys.field(1)], fps, ns, prints, [none] * len(texts))
        yield told([null, null], [None], [None], [None], [repeats(sets.values())])

    return rows.select(F.struct("row", F.col("doc_id").cast("long").alias("doc_id")).alias("key"), "text").mapInArrow(run, MARKS)


def frequent(marked: DataFrame) -> np.ndarray:
    """The shingles that repeat most, at most `FREQUENT`, the most frequent first. Any list would do: it only sets the order."""
    counts = marked.where("row is null").select(F.explode("often").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return top.column("token").to_numpy().view(np.uint64)


def prefix_length(n: int, least: float) -> int:
    """How many of the first of n shingles a set that is similar must share one of."""
    return min(n, n - math.ceil(least * n - 1e-6) + 1)


def prefixes(rows: DataFrame, shingle: int, last: np.ndarray, least: float = SIMILAR) -> DataFrame:
    """token, node, n: the first of the n shingles of each of rows(row, text), in the order of their mixed hashes; those of `last` come last, the first of them at the very end."""
    by_hash = np.argsort(last)
    spread = rows.sparkSession.sparkContext.broadcast((last[by_hash], len(last) - by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = spread.value
        for keys, texts in raw_texts(batches, "row", 64):
            own = [shingle_set(t, shingle) for t in texts]
            firsts = [np.zeros(0, np.uint64)]
            for s in own:
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                late = np.where(known[at] == s, place[at], 0) if len(known) else np.zeros(len(s), np.int64)
                mixed = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                firsts.append(s[np.lexsort((mixed, late))[: prefix_length(len(s), least)]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in firsts]), pa.int32()), pa.array(np.concatenate(firsts).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in own], pa.int32()), lists], ["node", "n", "tokens"])

    told = rows.select("row", "text").mapInArrow(run, "node long, n int, tokens array<long>")
    return told.select(F.explode("tokens").alias("token"), "node", "n")


def may_be_similar(c: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m shingles may be similar whose prefixes share c: behind the end of the prefix that ends first lie at most as many as behind the longer set's."""
    behind = F.ceil(F.greatest(n, m) * least - 1e-6) - 1
    return (F.greatest(n, m) * least <= F.least(n, m) + 1e-6) & (c + behind >= (n + m) * (least / (1 + least)) - 1e-6)


def prefix_pairs(members: DataFrame, least: float = SIMILAR) -> DataFrame:
    """u, v: the pairs of members(token, node, n, top) of unlike tops whose prefixes share enough to be similar.

    Of two prefixes one ends first; what both sets share beyond the `c` shingles of both prefixes lies behind that end, so at
    most c + max(n - prefix of n, m - prefix of m) are shared, and similar sets share least / (1 + least) * (n + m).
    """
    a, b = members.alias("a"), members.alias("b")
    size = F.greatest("a.n", "b.n") * least <= F.least("a.n", "b.n") + 1e-6
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.top") != F.col("b.top")) & size)
    pairs = met.groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("a.n").alias("n"), F.first("b.n").alias("m"))
    return pairs.where(may_be_similar(F.col("c"), F.col("n"), F.col("m"), least)).select("u", "v")


def chunk_pairs(members: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """placed(node, top, chunk) and x, y: the pairs of chunks, x <= y, that hold a token of members(token, node, top, met) in common.

    A node's chunk is one of those of its most crowded token (`met`). Chunks whose hashes clash are one, which leaves nothing out.
    """
    homes = cut(members.groupBy("node").agg(F.first("top").alias("top"), F.max(F.struct("met", "token"))["token"].alias("home")))
    parts = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = cut(homes.join(parts, "home").select("node", "top", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("chunk")))
    held = cut(members.select("token", "node").join(placed, "node").select("token", "chunk").distinct())
    marks = [F.bit_xor(F.xxhash64("chunk", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    alike = held.groupBy("token").agg(F.count(F.lit(1)).alias("chunks"), *marks).where("chunks > 1")
    unlike = alike.groupBy("chunks", "mark0", "mark1").agg(F.min("token").alias("token")).select("token")  # of tokens with the same chunks one
    open_ = cut(held.join(unlike, "token", "left_semi"))
    x, y = open_.select("token", F.col("chunk").alias("x")), open_.select("token", F.col("chunk").alias("y"))
    met = x.join(y, "token").where("x < y").select("x", "y")
    return placed, met.union(placed.select(F.col("chunk").alias("x"), F.col("chunk").alias("y"))).distinct()


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    places = []
    for sets, values in zip((a, b), flat, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[at] == values
        places.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known], at[known]))
    for start in range(0, len(both), COLUMNS):
        ones = []
        for sets, (row, column) in zip((a, b), places, strict=True):
            here = (column >= start) & (column < start + COLUMNS)
            ones.append(np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32))
            ones[-1][row[here], column[here] - start] = 1
        out += ones[0] @ ones[1].T
    return out


Side = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


def joining(a: Side, b: Side, least: float = SIMILAR) -> Iterator[tuple[int, int, bool]]:
    """u, v, sure: pairs of unlike tops between (nodes, tops, sizes, sets) a and b that are similar, enough of them for the same components, and those that may be (not sure).

    Sets are whole; those of over `SKETCH` values are sketches.
    """
    (nodes, tops, ns, own), (others, other_tops, ms, theirs) = a, b
    whole, other_whole = ns <= SKETCH, ms <= SKETCH
    fits = np.maximum.outer(ns, ms) * least <= np.minimum.outer(ns, ms) + 1e-6
    fits &= (tops[:, None] != other_tops[None, :]) & (nodes[:, None] != others[None, :])
    none = np.zeros(0, np.uint64)
    both = shared([x if w else none for x, w in zip(own, whole, strict=True)], [x if w else none for x, w in zip(theirs, other_whole, strict=True)]).astype(np.float64)
    known = whole[:, None] & other_whole[None, :]
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    for i, j in np.argwhere(fits & known & (both >= least * (ns[:, None] + ms[None, :] - both) - 1e-9)):
        s, t = find(int(tops[i])), find(int(other_tops[j]))
        if s != t:
            root[max(s, t)] = min(s, t)
            yield int(nodes[i]), int(others[j]), True
    cut_down = lambda x, w: sketch_of(x) if w else x
    open_ = []
    for i, j in np.argwhere(fits & ~known):
        s, t = find(int(tops[i])), find(int(other_tops[j]))
        if s == t:
            continue
        value, n = likeness(cut_down(own[i], whole[i]), cut_down(theirs[j], other_whole[j]))
        apart = DEVIATIONS * (least * (1 - least) / max(1, n)) ** 0.5
        if value >= least + apart:
            root[max(s, t)] = min(s, t)
            yield int(nodes[i]), int(others[j]), True
        elif value >= least - apart:
            open_.append((i, j))
    for i, j in open_:
        if find(int(tops[i])) != find(int(other_tops[j])):
            yield int(nodes[i]), int(others[j]), False


def reachable(nodes: DataFrame, rows: DataFrame, shingle: int, least: float = SIMILAR) -> DataFrame:
    """node, top, n, own array<long>: those of nodes(node, top) that can be similar to one of an unlike top, with the shingles that one of those has too; rows(row, text).

    Two sets share no more than what each of them shares with any text of an unlike top; a set of n shingles that is similar to
    another shares `least` * n with it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in raw_texts(batches, "key", 64):
            sets = [shingle_set(t, shingle).view(np.int64) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys.field(0), keys.field(1), pa.array([len(s) for s in sets], pa.int64()), lists], ["node", "top", "n", "own"])

    texts = within(rows.select("row", "text"), nodes.select(F.col("node").alias("row"), "top"), "inner")
    sets = texts.select(F.struct("row", "top").alias("key"), "text").mapInArrow(read, "node long, top long, n long, own array<long>")
    token = Window.partitionBy("token")
    held = sets.select("node", "top", "n", F.explode("own").alias("token")).withColumns({"low": F.min("top").over(token), "high": F.max("top").over(token)})
    live = held.where("low <> high").groupBy("node").agg(F.first("top").alias("top"), F.first("n").alias("n"), F.collect_list("token").alias("own"))
    return live.where(F.size("own") >= F.col("n") * least - 1e-6)


def crowded_links(members: DataFrame, rows: DataFrame, shingle: int, least: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """u, v, sure: the links, and pairs that may be (not sure), between unlike tops of members(token, node, top, met) that share a token; rows(row, text).

    Only `reachable` texts go to chunks, with their shared shingles alone where no sketch may be compared with their set.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in raw_texts(batches, "row", 64):
            sets = [shingle_set(t, shingle) for t in texts]
            own = pa.array([s.view(np.int64) if len(s) <= SKETCH else None for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch_of(s).tobytes() if len(s) > SKETCH else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, own, sketches], ["node", "whole", "sketch"])

    def side(value: pa.ListScalar) -> Side:
        nodes, tops, ns, own, sketches = value.values.flatten()
        ns = ns.to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) if n <= SKETCH else np.frombuffer(s.as_buffer(), np.uint32) for x, s, n in zip(own, sketches, ns, strict=True)]
        return nodes.to_numpy(), tops.to_numpy(), ns, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                found = list(joining(side(a), side(b), least))
                u, v, sure = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sure, pa.bool_())], ["u", "v", "sure"])

    live = cut(reachable(members.select("node", "top").distinct(), rows, shingle, least))
    long = F.col("n") > least * SKETCH  # may meet a sketch
    placed, pairs = chunk_pairs(within(members, live.select("node"), "left_semi", "node"), block)
    again = within(rows.select("row", "text"), live.where(long).select(F.col("node").alias("row")), "left_semi").mapInArrow(read, "node long, whole array<long>, sketch binary")
    sets = live.select("node", "n", F.when(~long, F.col("own")).alias("own")).join(again, "node", "left")
    sets = sets.select("node", "n", F.coalesce("own", "whole").alias("own"), "sketch")
    chunks = cut(placed.join(sets, "node").groupBy("chunk").agg(F.collect_list(F.struct("node", "top", "n", "own", "sketch")).alias("held")))
    met = pairs.join(chunks.select(F.col("chunk").alias("x"), F.col("held").alias("a")), "x").join(chunks.select(F.col("chunk").alias("y"), F.col("held").alias("b")), "y")
    return met.select("a", "b").mapInArrow(run, "u long, v long, sure boolean")


def judged(pairs: DataFrame, rows: DataFrame, shingle: int, least: float = SIMILAR) -> DataFrame:
    """u, v, sure: pairs(u, v) that are similar by the sketches of rows(row, text), or may be (not sure). Only texts of rows in a pair are read again."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in raw_texts(batches, "row", 64):
            yield pa.RecordBatch.from_arrays([keys, pa.array([sketch_of(shingle_set(t, shingle)).tobytes() for t in texts], pa.binary())], ["node", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            sure, keep = [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                value, n = likeness(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32))
                apart = DEVIATIONS * (least * (1 - least) / n) ** 0.5 if n else CLASHES / max(1, a.as_buffer().size // 4, b.as_buffer().size // 4)
                sure.append(value >= least + apart or value == 1 and not n)
                keep.append(value >= least - apart)
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sure, pa.bool_())], ["u", "v", "sure"])
            yield out.filter(pa.array(keep, pa.bool_()))

    nodes = cut(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    own = cut(within(rows.select("row", "text"), nodes, "left_semi").mapInArrow(sketched, "node long, sketch binary"))
    side = lambda key, name: own.select(F.col("node").alias(key), F.col("sketch").alias(name))
    met = dealt_join(pairs.select("u", "v").join(side("u", "a"), "u"), side("v", "b"), "v", "u", "inner", wide=True)
    return met.mapInArrow(run, "u long, v long, sure boolean")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node, own array<long>: the set of shingle hashes of each of rows(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in raw_texts(batches, "row", 64):
            sets = [shingle_set(t, shingle).view(np.int64) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, lists], ["node", "own"])

    return rows.select("row", "text").mapInArrow(run, "node long, own array<long>")


def confirmed(pairs: DataFrame, rows: DataFrame, shingle: int, least: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose whole sets have at least this Jaccard similarity. Only texts of rows in a pair are read again."""
    nodes = cut(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    sets = cut(shingle_sets(within(rows.select("row", "text"), nodes, "left_semi"), shingle))
    a, b = sets.select(F.col("node").alias("u"), F.col("own").alias("a")), sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return cut(pairs.join(a, "u").join(b, "v").where(both >= least * (F.size("a") + F.size("b") - both)).select("u", "v"))


def within(rows: DataFrame, keys: DataFrame, how: str, key: str = "row") -> DataFrame:
    """rows joined to a table of row numbers, which goes to all tasks only if it has at most `FEW`."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, how)


def keep_one(docs: DataFrame, shingle: int = 5, least: float = SIMILAR, dense: int = DENSE) -> DataFrame:
    """The rows of docs without those that a kept one nearly repeats: of each group the smallest doc_id stays, once. Columns as given.

    A group is what links of similarity `least` or more connect; texts with one set of shingles are a group from the start. A
    text of fewer words than a shingle is one shingle, and texts without a word (null and empty ones too) are equal. Rows
    with a null doc_id stay; of repeated rows of one doc_id one stays, and of its rows with unlike texts each. Very long texts
    are read whole. An empty table gives no row.
    """
    spark = docs.sparkSession
    key = next(c for c in map("_row{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    folder = new_folder(spark, "rows")
    docs.withColumn(key, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    rows = stored.select(F.col(key).alias("row"), "doc_id", "text")
    marked_folder = new_folder(spark, "marks")
    marks(rows.where("doc_id is not null"), shingle).write.parquet(marked_folder)
    marked = spark.read.parquet(marked_folder)
    first = F.min(F.struct("doc_id", "row")).alias("first")
    heads = cut(marked.where("row is not null").groupBy("print").agg(first, F.first("fp").alias("fp")).select(F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), "fp"))
    by_fp = cut(heads.groupBy("fp").agg(F.min("node").alias("node")))
    same = heads.select("fp", F.col("node").alias("u")).join(by_fp.select("fp", F.col("node").alias("v")), "fp").where("u <> v").select("u", "v")

    def settled(told: DataFrame) -> DataFrame:
        near = told.where("not sure").select("u", "v")
        return told.where("sure").select("u", "v") if near.isEmpty() else cut(told.where("sure").select("u", "v").union(confirmed(near, rows, shingle, least)))

    entries = prefixes(rows.where("doc_id is not null"), shingle, frequent(marked), least)
    several = entries.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("met > 1").drop("met")
    members = cut(several.join(heads.select("node"), "node", "left_semi"))
    lowest = F.min(F.struct("node", "n")).over(Window.partitionBy("token"))
    met = members.withColumn("low", lowest).select(F.col("node").alias("u"), "n", F.col("low.node").alias("v"), F.col("low.n").alias("m")).where("u <> v")
    starred = met.groupBy("u", "n", "v", "m").agg(F.count(F.lit(1)).alias("c")).where(may_be_similar(F.col("c"), F.col("n"), F.col("m"), least))
    to_first = starred.groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
    close = settled(cut(judged(cut(links(by_fp, dense).select("u", "v").union(same).union(to_first).distinct()), rows, shingle, least)))
    found = cut(star_components(close))
    tops = members.join(found, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("top"))
    meet = tops.groupBy("token").agg(F.count(F.lit(1)).alias("met"), F.min("top").alias("low"), F.max("top").alias("high")).where("low <> high").select("token", "met")
    open_ = cut(tops.join(meet, "token"))
    few = judged(cut(prefix_pairs(open_.where(F.col("met") <= CROWD), least)), rows, shingle, least)
    more = settled(cut(few.union(crowded_links(open_.where(F.col("met") > CROWD), rows, shingle, least))))
    found = found if more.isEmpty() else cut(star_components(close.union(more)))
    groups = heads.join(found, "node", "left").select(F.col("node").alias("row"), "doc_id", F.coalesce("component", "node").alias("group"))
    kept = groups.groupBy("group").agg(first).select(F.col("first.row").alias("row"))
    lost = cut(marked.where("row is not null").select("row").join(kept, "row", "left_anti"))
    return within(stored, lost.withColumnRenamed("row", key), "left_anti", key).select(*docs.columns)
