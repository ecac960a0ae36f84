"""Token files: each document's ids as a zstandard frame of its own, under one shared dictionary.

A shard file holds, in ascending doc_id order, the frames, then an index (doc_id, end of frame, tokens) and a footer with
the dictionary's hash. The dictionary lies beside the shards. It is trained on the serialised ids of a bounded sample of
documents: the `SAMPLE` smallest by hash among those of at most `SAMPLE_BYTES` bytes, since it is for short
documents that a dictionary matters; it changes sizes, never ids. Reading one document takes the footer, the index and
its own bytes.

Shards are ranges of doc_id, so their files are in order. Bounds come from doc_id alone; texts are encoded where they are
read and only frames move. A file is written beside its place and then renamed, with the same bytes at every
attempt, so a lost executor leaves nothing half-written.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantmill.llm.common import cut, new_folder
from plantmill.llm.pieces import Memo

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, KEPT = 1_000, 8_192, 65_536, 3, 250_000
SHARD_BYTES, BOUND_ROWS, NULL_ID = 64 << 20, 20, -(1 << 63)
MAGIC = b"PMTOK1\n\0"


# Letters that every Unicode version calls letters; the cuts below rest on nothing else.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
# Parts that end where the byte-level pre-tokeniser must end a token: a word before an ASCII non-letter, marks before
# white space or a letter, a line break before a letter, and otherwise all up to a space that a non-space follows.
PARTS = re.compile(rf" ?[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[.,;:!?]+(?=[\s{LETTERS}]|\Z)|\n(?=[{LETTERS}])|[\s\S]+?(?= \S|\Z)")
WORD = re.compile(rf" ?[{LETTERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """A tokenizer with the ids of recent parts of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_word = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in spec["added_tokens"]]
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.model = self.tokenizer.model
        self.parts = Memo(self.part_ids, KEPT)
        self.letters = dict(enumerate(byte_letters()))

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def part_ids(self, part: str) -> bytes:
        if part.isascii() and part[part[0] == " " :].isalpha():  # one token of the pre-tokeniser, of bytes that mostly stand for themselves
            return self.pack([t.id for t in self.model.tokenize(part.replace(" ", self.letters[32]))])
        if WORD.fullmatch(part):
            return self.pack([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        return self.pack(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.by_word and not any(s in text for s in self.special):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text)))
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from the serialised ids of a bounded sample; empty if there is too little to learn from."""
    short = docs.where(F.col("doc_id").isNotNull() & F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = short.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    # A share of the hashes that holds about twice the sample, so that no partition sends a sample of its own to the driver.
    share = min(1.0, 2 * sample / max(1, short.count()))
    some = rows if share == 1.0 else rows.where(F.col("h") < F.lit(int((2 * share - 1) * (1 << 63))))
    rows = some.orderBy("h", "doc_id", "text").limit(sample).collect()
    enc = encoder(tokenizer)
    samples = [enc.encode(r["text"]) + enc.pack([end_id]) for r in rows]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 4_096:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1_024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, data: list[bytes], attempt: int) -> None:
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(f"{path}.{attempt}") as out:
        for d in data:
            out.write(d)
    files.move(f"{path}.{attempt}", path)


def _zdict(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write docs as token files in `folder`; return the manifest: shard, path, n_docs, n_tokens, one row per file.

    Shards are ranges of doc_id in ascending order, of about `SHARD_BYTES` of text unless their number is given; rows of one
    doc_id stay together, ordered by their ids' bytes; a null doc_id comes first. Very long texts are encoded whole. An empty
    table writes a dictionary and no shard. Extra columns are ignored.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = shards or max(1, -(-size // SHARD_BYTES))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    _put(f"{folder}/dictionary", [dictionary], 0)
    width = encoder(tokenizer).dtype.itemsize
    # Bounds from a share of the ids by hash: about `BOUND_ROWS` numbers a shard reach the driver.
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    share = min(1.0, BOUND_ROWS * shards / max(1, n))
    some = ids if share == 1.0 else ids.where(F.xxhash64("doc_id") < F.lit(int((2 * share - 1) * (1 << 63))))
    known = np.sort(some.toPandas()["doc_id"].to_numpy(np.int64)) if shards > 1 else np.zeros(0, np.int64)
    bounds = spark.sparkContext.broadcast(np.unique(known[np.arange(1, shards) * len(known) // shards]) if len(known) else known)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids and frames in one pass, so that a core has one Python worker."""
        enc, zip_ = encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_zdict(dictionary))
        end = enc.pack([end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, frames = [], []
                for t in part.column("text").to_pylist():
                    ids = enc.encode(t or "") + end
                    counts.append(len(ids) // width)
                    frames.append(zip_.compress(ids))
                shard = np.searchsorted(bounds.value, part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary()), pa.array(shard, pa.int32())], ["doc_id", "n_tokens", "frame", "shard"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, keys, ends, tokens, at = f"{folder}/shard-{context.partitionId():06d}", [], [], [], 0
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        files, path = _open(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        # Frames go out as they come; only the index stays.
        with files.open_output_stream(f"{path}.{context.taskAttemptId()}") as out:
            for b in itertools.chain([first], filled):
                keys.append(b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                own = b.column("frame").to_pylist()
                out.write(b"".join(own))
                ends.append(at + np.cumsum(np.fromiter(map(len, own), np.int64)))
                at = int(ends[-1][-1])
                tokens.append(b.column("n_tokens").to_numpy())
            index = [np.concatenate(keys).astype("<i8"), np.concatenate(ends).astype("<u8"), np.concatenate(tokens).astype("<u8")]
            head = json.dumps({"docs": len(index[0]), "width": width, "dictionary_sha256": digest, "data": at}).encode()
            for x in (*(x.tobytes() for x in index), head, struct.pack("<Q", len(head)), MAGIC):
                out.write(x)
        files.move(f"{path}.{context.taskAttemptId()}", path)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [name], "n_docs": [len(index[0])], "n_tokens": [int(index[2].sum())]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(squeeze, "doc_id long, n_tokens long, frame binary, shard int")
    dealt = rows.repartitionById(len(bounds.value) + 1, "shard").sortWithinPartitions("doc_id", "frame").drop("shard")
    return cut(dealt.mapInArrow(store, "shard long, path string, n_docs long, n_tokens long"))


class Shard:
    """One shard file: its index, and any document's ids."""

    def __init__(self, uri: str, dictionary: bytes | None = None):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        n = struct.unpack("<Q", self.file.read(16)[:8])[0]
        self.file.seek(size - 16 - n)
        self.head = json.loads(self.file.read(n))
        docs = self.head["docs"]
        self.file.seek(self.head["data"])
        raw = self.file.read(24 * docs)
        self.doc_ids, ends, self.n_tokens = (np.frombuffer(raw, kind, docs, 8 * docs * k) for k, kind in enumerate(("<i8", "<u8", "<u8")))
        self.ends = ends.astype(np.int64)
        if dictionary is None:
            other, at = _open(uri.rpartition("/")[0] + "/dictionary")
            with other.open_input_file(at) as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.head["dictionary_sha256"]:
            raise ValueError(f"{uri} was written with another dictionary")
        self.unzip = zstandard.ZstdDecompressor(**_zdict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document: one read of its own bytes."""
        start = int(self.ends[k - 1]) if k else 0
        self.file.seek(start)
        return np.frombuffer(self.unzip.decompress(self.file.read(int(self.ends[k]) - start)), "<u2" if self.head["width"] == 2 else "<u4")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids binary (little-endian 32-bit): every document of the files, `start` ids before it."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files = manifest.select("path", before.alias("base")).repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                starts = base + np.cumsum(shard.n_tokens.astype(np.int64)) - shard.n_tokens.astype(np.int64)
                for at in range(0, len(starts), 512):
                    some = range(at, min(at + 512, len(starts)))
                    keys = [None if shard.doc_ids[k] == NULL_ID else int(shard.doc_ids[k]) for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(starts[at : some.stop]), pa.array(shard.n_tokens[at : some.stop].astype(np.int64)), pa.array([shard.ids(k).astype("<u4").tobytes() for k in some], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_and_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from files newly written to the shared folder."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, new_folder(spark, "tokens"), tokenizer, end_id)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
