"""SentencePiece encoding and decoding by a relational lattice.

The frequent words of the corpus become lattices in Spark: every substring of bounded length is a row, an equi-join with
the piece table keeps those that are pieces, and the edges meet by word. A Viterbi fold (`aggregate`) then goes over the
end positions: the model is a BPE model, whose best path is not a sum of scores but the one path whose adjacent pieces are
compatible (see `pieces`), so the state at a position is its one surviving last edge, and a second fold walks back.

A text is its words' codes side by side (see `pieces` for what counts as a word), runs of spaces apart. The words of the lattice
table are those with at least the count at which the table has no more than `TABLE` rows, so that its size is bounded at
any size of corpus; it goes to all tasks. A rarer word, and one of `LONGEST_WORD` characters or more, gets the same search in
the task that meets it. No text is shuffled: the alternative, joining every word of
every document to its code and collecting each document again, moves more bytes than the corpus has.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmill.llm import pieces
from plantmill.llm.common import cut

TABLE, LONGEST_WORD, KEPT, HELD = 100_000, 64, 150_000, 250_000

EDGE = T.StructType([T.StructField("len", T.IntegerType()), T.StructField("rank", T.IntegerType())])
PIECES = T.StructType([
    T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("rank", T.IntegerType()),
    T.StructField("right", T.ArrayType(EDGE)), T.StructField("left", T.ArrayType(EDGE)),
])


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, rank, right, left: the pieces that an encoding can have with both edges of their merge trees. One model file bounds it."""
    m = pieces.load(model)
    edge = lambda p, right: [(len(x), r) for x, r in m.spine(p, right)]
    rows = [(p, m.ids[p], m.rank.get(p, pieces.NEVER), edge(p, True), edge(p, False)) for p in [*m.single, *m.rank] if len(p) == 1 or m.split(p)]
    return spark.createDataFrame(rows, PIECES)


def chunk_counts(docs: DataFrame, model: str) -> DataFrame:
    """w (a chunk of a text), n: partial counts of all chunks that can be in the table; a task holds `HELD` distinct ones at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held = pieces.load(model).chunks, Counter()

        def some() -> pa.RecordBatch:
            own = [w for w in held if len(w) < LONGEST_WORD and pieces.MARK not in w]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([held[w] for w in own], pa.int64())], ["w", "n"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    held.update(chunks(t))
                    if len(held) > HELD:
                        yield some()
                        held.clear()
        yield some()

    return docs.select("text").mapInArrow(run, "w string, n long")


def frequent_words(docs: DataFrame, model: str, most: int = TABLE) -> DataFrame:
    """word (a chunk, its leading space as a space mark), n: all with at least the count at which there are no more than `most`."""
    counts = cut(chunk_counts(docs, model).groupBy("w").agg(F.sum("n").alias("n")).where("n > 1"))
    kept, least = 0, 2
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        kept += r["words"]
        if kept > most:
            least = r["n"] + 1
            break
    return counts.where(F.col("n") >= least).select(F.translate("w", " ", pieces.MARK).alias("word"), "n")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """word, edges array<struct<end, start, id, rank, right, left>>; id is null for a character that is no piece."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + longest))).alias("end"))
    spans = spans.withColumn("piece", F.expr("substring(word, start + 1, end - start)"))
    edges = spans.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("end") - F.col("start") == 1))
    return edges.groupBy("word").agg(F.collect_list(F.struct("end", "start", "id", "rank", "right", "left")).alias("edges"))


def viterbi(lattices: DataFrame, first_byte: int) -> DataFrame:
    """word, ids array<int>: the one path of compatible pieces."""
    # A character that is no piece joins nothing.
    alone = F.array(F.struct(F.lit(1).alias("len"), F.lit(pieces.NEVER).alias("rank")))
    edges = F.transform("edges", lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), e["id"].alias("id"), F.coalesce(e["rank"], F.lit(pieces.NEVER)).alias("rank"), F.coalesce(e["right"], alone).alias("right"), F.coalesce(e["left"], alone).alias("left")))
    ready = lattices.select("word", edges.alias("edges"), F.length("word").alias("n"))

    def clash(before: Column, e: Column) -> Column:
        joined = lambda a, b: F.exists("edges", lambda x: (x["start"] == e["start"] - a["len"]) & (x["end"] == e["start"] + b["len"]) & (x["rank"] < a["rank"]) & (x["rank"] <= b["rank"]) & (x["rank"] < pieces.NEVER))
        return F.exists(before["right"], lambda a: F.exists(e["left"], lambda b: joined(a, b)))

    def survivor(state: Column, end: Column) -> Column:
        fits = lambda e: (e["end"] == end) & ((e["start"] == 0) | ~clash(F.get(state, e["start"] - 1), e))
        return F.concat(state, F.slice(F.filter("edges", fits), 1, 1))

    empty = F.slice(F.col("edges"), 1, 0)
    path = F.aggregate(F.sequence(F.lit(1), F.col("n")), empty, survivor)
    back = ready.select("word", "n", F.transform(path, lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), e["id"].alias("id"))).alias("last"))
    start = F.struct(F.col("n").alias("at"), F.array().cast("array<struct<end:int,start:int,id:int>>").alias("path"))

    def step(s: Column, end: Column) -> Column:
        e = F.get(F.col("last"), end - 1)
        return F.when(s["at"] == end, F.struct(e["start"].alias("at"), F.concat(F.array(e), s["path"]).alias("path"))).otherwise(s)

    walked = F.aggregate(F.sequence(F.col("n"), F.lit(1), F.lit(-1)), start, step, lambda s: s["path"])

    def ids(e: Column) -> Column:
        code = F.hex(F.encode(F.expr("word").substr(e["end"], F.lit(1)), "UTF-8"))
        bytes_ = F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda k: (F.conv(F.substr(code, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first_byte))
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(bytes_)

    return back.select("word", F.flatten(F.transform(walked, ids)).alias("ids"))


def word_codes(docs: DataFrame, model: str, most: int = TABLE) -> DataFrame:
    """word, ids of the frequent words of docs."""
    m = pieces.load(model)
    return viterbi(lattice(frequent_words(docs, model, most).select("word"), piece_table(docs.sparkSession, model), m.longest), m.bytes[0])


class Codes(pieces.Memo):
    """chunk -> ids as bytes of int32; chunks outside the table are searched when they are met."""

    def __init__(self, table: dict[str, bytes], model: str):
        m = self.pieces = pieces.load(model)
        super().__init__(lambda chunk: table.get(chunk) or array("i", m.encode(chunk.replace(" ", pieces.MARK))).tobytes(), KEPT)


_CODES: dict[tuple[int, str], Codes] = {}


def _codes(shared: Broadcast, model: str) -> Codes:
    """The codes of this broadcast table, kept for the worker's next tasks."""
    key = (id(shared.value), model)
    if key not in _CODES:
        _CODES.clear()
        _CODES[key] = Codes(shared.value, model)
    return _CODES[key]


def encode_text(text: str, codes: Codes) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    m = codes.pieces
    if not ("  " in text or text[0] == " " or text[-1] == " " or pieces.MARK in text):
        return np.frombuffer(b"".join(map(codes.__getitem__, m.chunks(text))), np.int32)
    out, mark = [], array("i", [m.ids[pieces.MARK]]).tobytes()
    runs = lambda n: array("i", m.mark_ids(n)).tobytes()
    for run, word in pieces.segments(text):  # every word follows a mark
        if not word:
            out.append(runs(run))
            continue
        ids = b"".join(map(codes.__getitem__, m.chunks(word)))
        out += [runs(run), ids[4:]] if ids.startswith(mark) else [runs(run - 1), ids]
    return np.frombuffer(b"".join(out), np.int32)


def encode(docs: DataFrame, model: str, most: int = TABLE, spell: bool = False) -> DataFrame:
    """docs with `ids` array<int>: the model's encoding of each whole text, no begin or end added.

    With `spell`, also `decoded`: the text that those ids spell (as `decode` gives it, in the same pass). A null text has no
    id, like an empty one. Every row stays, repeated ones too, with all its columns (columns named ids or decoded are
    replaced). Very long texts and words take time and memory in proportion to their length; an empty table gives no row.
    """
    docs = docs.drop("ids", *(["decoded"] if spell else []))
    rows = word_codes(docs, model, most).toLocalIterator(prefetchPartitions=True)
    shared = docs.sparkSession.sparkContext.broadcast({r["word"].replace(pieces.MARK, " "): np.array(r["ids"], np.int32).tobytes() for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(shared, model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode_text(t or "", codes) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)])
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))]
                if spell:
                    columns.append(pa.array([spelled(x, codes.pieces) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    added = ["ids", "decoded"] if spell else ["ids"]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, kinds[c]) for c in added)]))


def spelled(ids: np.ndarray, m: pieces.Pieces) -> str:
    return b"".join(map(m.text.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with `decoded` string: the text that the ids of each row spell; null ids spell an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces.load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [spelled(ids, m) for ids in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in part.column("ids"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
