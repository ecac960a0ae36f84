"""Token counts by prefix dynamic programming.

The table of a text holds the exact number of tokens of every prefix, as if each had been encoded alone. It is filled from
left to right: the encoding of a prefix ends in the one piece that is compatible with the encoding before it, so its count
is one more than that of a shorter prefix (`Pieces.prefixes`). The table falls into chunks; those of frequent
chunks are kept for the next texts. Truncation and budget questions are lookups: `longest_prefix` finds where to
cut, `budget_cut` does so for a table of documents, and nothing is encoded twice.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmill.llm import pieces
from plantmill.llm.common import raw_texts

KEPT = 200_000  # chunks in each of a worker's two generations


@lru_cache(maxsize=4)
def chunk_tables(model: str) -> pieces.Memo:
    """chunk -> counts of its prefixes, as bytes of uint32."""
    m = pieces.load(model)
    return pieces.Memo(lambda chunk: array("I", m.prefixes(chunk.replace(" ", pieces.MARK))[0]).tobytes(), KEPT)


def prefix_table(text: str, model: str) -> np.ndarray:
    """Token counts of text[:1], text[:2], ... text: int64 array of the text's length."""
    if not text:
        return np.zeros(0, np.int64)
    m = pieces.load(model)
    if "  " in text or text[0] == " " or text[-1] == " " or pieces.MARK in text:
        return _with_runs(text, m)
    chunks = m.chunks(text)
    local = np.frombuffer(b"".join(map(chunk_tables(model).__getitem__, chunks)), np.uint32)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    totals = np.cumsum(local[np.cumsum(sizes) - 1], dtype=np.int64)
    return (local + np.repeat(np.r_[0, totals[:-1]], sizes))[1:]


def _with_runs(text: str, model: pieces.Pieces) -> np.ndarray:
    """The same for texts with runs of spaces, or with spaces at an end."""
    out, before = [], 0
    for run, word in pieces.segments(text):
        for k in range(1, run + 1):
            out.append(before + len(model.marks(k)))
        if not word:
            continue
        counts, lone, _ = model.prefixes(pieces.MARK * (run > 0) + word)
        joined = len(model.marks(run - 1)) if run else 0
        apart = len(model.marks(run)) - 1 if run else 0
        out += [before + c + (apart if alone else joined) for c, alone in zip(counts[run > 0 :], lone[run > 0 :], strict=True)]
        before = out[-1]
    return np.array(out[1:], np.int64)


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens (a longer prefix can have fewer tokens)."""
    fitting = np.flatnonzero(table <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def token_counts(docs: DataFrame, model: str, budget: int, with_table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits_chars and, if asked for, prefix_counts array<long>: one row per row of docs.

    Null and empty texts have no token. fits_chars: characters of the longest prefix within the budget. Repeated rows
    each keep a row, a null doc_id stays null, extra columns are ignored. A text takes memory in proportion to its length.
    """
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "fits_chars": pa.int64()} | ({"prefix_counts": pa.list_(pa.int64())} if with_table else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in raw_texts(batches, "doc_id"):
            rows = []
            for raw in texts:
                t = prefix_table(raw.decode(), model)
                n = int(t[-1]) if len(t) else 0
                rows.append((len(raw), n, len(t) if n <= budget else longest_prefix(t, budget), *([t] if with_table else [])))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), list(fields.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], list(fields))

    schema = "doc_id long, n_bytes long, n_tokens long, fits_chars long" + ", prefix_counts array<long>" * with_table
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def budget_cut(docs: DataFrame, model: str, budget: int) -> DataFrame:
    """docs with each text cut to its longest prefix of at most `budget` tokens; all rows and columns as given.

    The cut is a lookup in the text's prefix table, so nothing is joined: repeated rows, equal ids with other texts and a null
    doc_id are each cut on their own. A null text stays null, an empty one empty.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else t[: longest_prefix(prefix_table(t, model), budget)] for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
