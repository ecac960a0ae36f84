"""Benchmark decontamination with an FM-index for each shard of training documents.

A task reads its documents in shards of about `SHARD` words. A shard's words become symbols: words of no test phrase are
separators, which no phrase can cross. Its suffix array is sorted up to the next separator, and gives the
Burrows-Wheeler transform, kept as a wavelet tree of bit levels with counted ranks. All phrases are searched backwards at
once; suffix positions are sampled at every `SAMPLE`-th symbol of a run and at each run's start, and the other
occurrences walk back to one. Occurrences of a document merge into spans. No row leaves its task: there is no shuffle.

The phrases go to all executors. Their size is checked: a benchmark of more than `BLOCK` windows is searched in
blocks of that many, one pass each over the texts as given. Each block's hits are written to the shared folder before the
next block is loaded; then they are joined by document, and texts are cut once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantmill.llm.common import cut, raw_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW, SHARD, SAMPLE, BLOCK, BLOCK_BYTES = 10, 400_000, 8, 500_000, 32 << 20
SEED = 42  # of Spark's xxhash64


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes: lower-cases A-Z only


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Ranks:
    """Symbol counts before a row: a wavelet tree stored as one bit level after another, highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            on = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(on, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((ones, zeros))
            on = on.astype(bool)
            symbols = np.concatenate([symbols[~on], symbols[on]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often symbol stands in rows before `row`."""
        low, high = np.zeros_like(row), row
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            on = ((symbol >> b) & 1).astype(bool)
            a, z = ones[low], ones[high]
            low, high = np.where(on, zeros + a, low - a), np.where(on, zeros + z, high - z)
        return high - low

    def symbol_and_rank(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of a row, and how often it stands before it."""
        symbol, low, high = np.zeros_like(row), np.zeros_like(row), row
        for ones, zeros in self.levels:
            on = (ones[high + 1] - ones[high]).astype(bool)
            symbol = (symbol << 1) | on
            a, z = ones[low], ones[high]
            low, high = np.where(on, zeros + a, low - a), np.where(on, zeros + z, high - z)
        return symbol, high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. Separators (0) sort by position, so each comparison ends at one.

    Prefix doubling: after each round only positions whose rank is still shared are sorted again.
    """
    n = len(symbols)
    free = symbols == 0
    n_free = int(free.sum())
    rank = symbols.astype(np.int64) + n_free
    rank[free] = np.arange(n_free)
    order = np.argsort(rank, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if n else np.zeros(0, int)
    rank[order] = np.repeat(firsts, np.diff(np.r_[firsts, n]))  # a rank is the first row of its group
    step = 1
    sizes = np.diff(np.r_[firsts, n])
    rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(rows):
        at = order[rows]
        beyond = at + step
        key = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        group = rank[at]
        again = np.argsort(group * (n + 1) + key + 1, kind="stable")
        at, group, key = at[again], group[again], key[again]
        order[rows] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(rows)])
        rank[at] = np.repeat(rows[starts], size)
        rows = rows[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Counts and places phrases in one shard. symbols: 0 is a separator and stands at the end and between documents."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        before = symbols[order - 1]  # position 0 takes the last symbol, a separator
        self.first = np.zeros(n_symbols + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(symbols, minlength=n_symbols))
        self.ranks = Ranks(before.astype(np.int32), max(1, int(n_symbols - 1).bit_length()))
        starts = np.flatnonzero(np.r_[0, symbols[:-1]] == 0)
        in_run = np.arange(len(symbols)) - starts[np.searchsorted(starts, np.arange(len(symbols)), side="right") - 1]
        kept = (in_run % sample == 0)[order]
        self.sampled = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(kept, out=self.sampled[1:])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases: 2-D, filled on the left with 0."""
        n = len(phrases)
        low, high = np.zeros(n, np.int64), np.full(n, self.first[-1])
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            go = np.flatnonzero((symbol > 0) & (low < high))
            s = symbol[go]
            low[go], high[go] = self.first[s] + self.ranks.rank(s, low[go]), self.first[s] + self.ranks.rank(s, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row: walk back to a sampled one."""
        out, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled[at + 1] > self.sampled[at]
            out[left[done]] = self.positions[self.sampled[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol, rank = self.ranks.symbol_and_rank(at)
                at = self.first[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of the benchmark, and the items that have each."""

    def __init__(self, windows: list[tuple[list[bytes], list[str]]], width: int = WINDOW):
        found = {tuple(w): items for w, items in windows}
        self.items = list(found.values())
        self.code = {w: i + 1 for i, w in enumerate(sorted({x for key in found for x in key}))}
        self.length = np.array([len(w) for w in found], np.int64)
        self.table = np.zeros((len(found), width), np.int64)
        for i, key in enumerate(found):
            self.table[i, width - len(key) :] = [self.code[x] for x in key]


def hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, np.ndarray, list[str]]]:
    """For each text of a shard: its words, those hit (word numbers), and the items found."""
    get, parts, lengths = phrases.code.get, [], []
    for t in texts:
        words = words_of(t)
        codes = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        lengths.append(len(codes))
        parts += [codes, [0]]
    if not parts or not len(phrases.table):
        return [(n, np.zeros(0, np.int64), []) for n in lengths]
    symbols = np.concatenate(parts).astype(np.int64)
    index = FMIndex(symbols, len(phrases.code) + 1)
    low, high = index.search(phrases.table)
    which = np.flatnonzero(high > low)
    counts = (high - low)[which]
    phrase = np.repeat(which, counts)
    rows = np.repeat(low[which], counts) + np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.locate(rows)
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.length[phrase], -1)
    covered = np.cumsum(change)[:-1] > 0
    begins = np.cumsum([0, *(n + 1 for n in lengths)])
    of = np.searchsorted(begins, at, side="right") - 1
    names: dict[int, set[str]] = {}
    for d, p in set(zip(of.tolist(), phrase.tolist(), strict=True)):
        names.setdefault(d, set()).update(phrases.items[p])
    return [(n, np.flatnonzero(covered[b : b + n]) if d in names else np.zeros(0, np.int64), sorted(names.get(d, ()))) for d, (n, b) in enumerate(zip(lengths, begins, strict=False))]


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged byte spans [start, end) of runs of hit words."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    cuts = np.flatnonzero(np.diff(hit) > 1)
    return [(places[a][0], places[b][1]) for a, b in zip(hit[np.r_[0, cuts + 1]], hit[np.r_[cuts, len(hit) - 1]], strict=True)]


def without(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """words array<binary>, items array<string>: each distinct window of the benchmark with the items that have it.

    Null item_ids are named "null"; null texts have no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in raw_texts(batches, "item_id"):
            found = [(str(i), list(w)) for i, t in zip(ids.to_pylist(), texts, strict=True) for w in set(windows_of(words_of(t), width))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.list_(pa.binary()))], ["item", "words"])

    each = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").mapInArrow(run, "item string, words array<binary>")
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


FOUND = "doc_id long, print long, n_words long, hit array<long>, spans array<struct<start: long, end: long>>, items array<string>"


def scan(docs: DataFrame, phrases: Phrases, shard: int = SHARD) -> DataFrame:
    """One row per document (FOUND) for one block of phrases. print: Spark's xxhash64 of the text."""

    def judged(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        found = hits(texts, phrases)
        spans = [spans_of(t, h) if len(h) else [] for t, (_, h, _) in zip(texts, found, strict=True)]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "print": pa.array(np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)),
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "hit": pa.array([h.tolist() for _, h, _ in found], pa.list_(pa.int64())),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(span)),
            "items": pa.array([i for _, _, i in found], pa.list_(pa.string())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for some_ids, some in raw_texts(batches, "doc_id"):
            for i, t in zip(some_ids.to_pylist(), some, strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) // 6 + 2
                if size >= shard:
                    yield judged(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield judged(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def blocks_of(benchmark: DataFrame, width: int = WINDOW, block: int = BLOCK) -> tuple[int, Iterator[Phrases]]:
    """The number of blocks, and the benchmark's windows: about `block` at a time on the driver and in a task, and `BLOCK_BYTES` of words at most."""
    ready = cut(windows(benchmark, width))
    size = F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))), F.lit(0))
    n, total = ready.agg(F.count(F.lit(1)), size).first()
    parts = max(1, -(-n // block), -(-total // BLOCK_BYTES))

    def load() -> Iterator[Phrases]:
        for k in range(parts):
            own = ready if parts == 1 else ready.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)
            yield Phrases([([bytes(w) for w in r["words"]], r["items"]) for r in own.toLocalIterator()], width)

    return parts, load()


def united(docs: DataFrame, blocks: Iterator[Phrases], shard: int) -> DataFrame:
    """doc_id, print, hit, items: what all blocks find in the documents that have a hit. One block is held at a time."""
    out = None
    for phrases in blocks:
        found = cut(scan(docs, phrases, shard).where(F.size("hit") > 0).select("doc_id", "print", "hit", "items"))
        out = found if out is None else out.unionByName(found)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return out.groupBy("doc_id", "print").agg(joined("hit"), joined("items"))  # equal rows of docs have equal rows here


def free_prefix(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with."""
    return next(p for p in map("_".__mul__, range(1, 1000)) if not any(c.startswith(p) for c in docs.columns))


def with_hits(docs: DataFrame, found: DataFrame, p: str = "_") -> DataFrame:
    """docs and, as `hit` and `items` after the prefix p, what `united` found in each row; null without a hit."""
    found = found.select(F.col("doc_id").alias(f"{p}doc"), F.col("print").alias(f"{p}print"), F.col("hit").alias(f"{p}hit"), F.col("items").alias(f"{p}items"))
    same = docs["doc_id"].cast("long").eqNullSafe(found[f"{p}doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[f"{p}print"])
    return docs.join(found, same, "left").drop(f"{p}doc", f"{p}print")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items: what of the benchmark each document holds.

    A window is `width` consecutive words of an item, or the whole of a shorter item that has a word. spans: merged
    byte spans of hit words. Null and empty texts have no words and no hit; very long texts are searched whole; repeated rows
    each keep a row, a null doc_id too; an item that occurs twice is named once; extra columns
    are ignored; an empty benchmark hits nothing.
    """
    parts, blocks = blocks_of(benchmark, width, block)
    if parts == 1:
        return scan(docs, next(blocks), shard).select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "spans", "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            hit = [np.array(h or [], np.int64) for h in b.column("_hit").to_pylist()]
            spans = [[{"start": x, "end": y} for x, y in spans_of(t, h)] if len(h) else [] for t, h in zip(texts, hit, strict=True)]
            counts = pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array(list(map(len, hit)), pa.int64())
            items = pa.array([i or [] for i in b.column("_items").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(spans, span), items], ["doc_id", "n_words", "n_hit", "spans", "items"])

    schema = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"
    return with_hits(rows, united(docs, blocks, shard)).mapInArrow(run, schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard: int = SHARD, block: int = BLOCK, least: int = 1) -> DataFrame:
    """docs without the benchmark's spans; a document that loses all but fewer than `least` words goes.

    Columns as given; n_chars, if there, follows the text. Every block of phrases is searched in the text as given, and the
    text is cut once. Documents without a hit stay as they are, null and empty texts too. Repeated rows are cut each, and so are
    rows with a null doc_id. Other columns stay, whatever their names. An empty table gives no row.
    """
    parts, blocks = blocks_of(benchmark, width, block)
    if parts == 1:
        phrases = next(blocks)
        return _cleaned(docs, lambda texts, rows: [(n, h) for n, h, _ in hits(texts, phrases)], docs.schema, shard, least)

    p = free_prefix(docs)

    def found(texts: list[bytes], rows: pa.Table) -> list[tuple[int, np.ndarray]]:
        hit = [np.array(h or [], np.int64) for h in rows[f"{p}hit"].to_pylist()]
        return [(len(words_of(t)) if len(h) else 0, h) for t, h in zip(texts, hit, strict=True)]

    return _cleaned(with_hits(docs, united(docs, blocks, shard), p).drop(f"{p}items"), found, docs.schema, shard, least)


def _cleaned(docs: DataFrame, search: Callable[[list[bytes], pa.Table], list[tuple[int, np.ndarray]]], schema: StructType, shard: int, least: int) -> DataFrame:
    """docs in the given schema, cut at what `search` gives for each text of a shard: its words, and those hit."""

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = [t or b"" for t in rows["text"].cast(pa.binary()).to_pylist()]
        old, keep, changed = rows["text"].to_pylist(), [], {}
        for k, (t, (n, hit)) in enumerate(zip(texts, search(texts, rows), strict=True)):
            keep.append(not len(hit) or n - len(hit) >= least)
            if len(hit):
                changed[k] = old[k] = without(t, spans_of(t, hit))
        rows = rows.select(names)
        if changed:
            rows = rows.set_column(rows.column_names.index("text"), rows.schema.field("text"), pa.array(old, rows.schema.field("text").type))
            if "n_chars" in rows.column_names:
                counts = rows["n_chars"].to_pylist()
                for k, t in changed.items():
                    counts[k] = len(t)
                rows = rows.set_column(rows.column_names.index("n_chars"), rows.schema.field("n_chars"), pa.array(counts, rows.schema.field("n_chars").type))
        yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += held[-1].column("text").nbytes // 6 + 512
                if size >= shard:
                    yield from judged(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from judged(pa.Table.from_batches(held))

    names = schema.names
    return docs.mapInArrow(run, schema)
