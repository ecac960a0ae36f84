"""Language identification in two steps: first the family, then the language within it.

Both steps are linear support vector machines on hashed byte n-grams (1 to 3 bytes of the lower-cased text, counts scaled
to length 1). A family is chosen one against the rest; within it every pair of languages has a machine of its own, and the
language with most wins is taken, the sum of margins breaking ties. The machines learn from a bounded sample of labelled
rows: about `SAMPLE` for each language, by hash, so any order of the table gives the same ones. The driver trains them on
the sample's vectors (16 KB a row); prediction reads whole texts and needs no shuffle.

The score compares languages with each other, so it is never low. Whether a text is in any of them is told by how far
it lies inside its winner (`Model.inside`): the least raw margin, and the cosine to the winner's mean vector. The least
values allowed come from the sample: machines of one half read the other half (`limits`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.llm.common import raw_texts

SAMPLE, BUCKETS, CHUNK = 400, 4_096, 1 << 20
# The percentile of clean rows that sets a limit, and the shares of it that a margin and a cosine must reach.
CLEAN, MARGIN_SHARE, COSINE_SHARE = 1.0, 0.5, 0.8
# Families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
ASCII_LETTER = re.compile(rb"[A-Za-z]")
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def vector(text: bytes) -> np.ndarray:
    """Hashed byte n-gram counts of the whole text, lower-cased, as a float32 vector of length 1."""
    text = text.decode("utf-8", "replace").lower().encode() if not text.isascii() else text.lower()
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), CHUNK):  # bounds memory; two bytes of overlap keep every n-gram
        b = np.frombuffer(text[max(0, at - 2) : at + CHUNK], np.uint8).astype(np.uint32)
        own = min(at, 2)
        two = b[:-1] * 257 + b[1:] + 65_537
        three = two[:-1] * 263 + b[2:] + 7_919
        for grams, skip in ((b, own), (two[max(0, own - 1) :], 0), (three, 0)):
            mixed = (grams[skip:] * np.uint32(2_654_435_761)) >> np.uint32(20)
            counts += np.bincount(mixed, minlength=BUCKETS)
    norm = float(np.sqrt(np.square(counts.astype(np.float64)).sum()))
    return (counts / norm if norm else counts).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])  # single precision; sums with w are double
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x, dtype=np.float64) + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    by_family: np.ndarray  # a row of weights for each family
    by_pair: dict[tuple[str, str], np.ndarray]
    centres: dict[str, np.ndarray]  # each language's mean vector, of length 1

    def inside(self, x: np.ndarray, lang: str) -> tuple[float, float]:
        """The least raw margin of lang's machines (infinite without any), and the cosine to its mean vector."""
        one, family = np.append(x, np.float32(1)), FAMILY.get(lang, lang)
        margins = [float(self.by_family[self.families.index(family)] @ one)] if len(self.families) > 1 else []
        margins += [float(w @ one) * (1 if lang == a else -1) for (a, b), w in self.by_pair.items() if lang in (a, b)]
        return min(margins, default=np.inf), float(self.centres[lang] @ x)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, np.float32(1))
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            margins = self.by_family @ x
            best, second = np.argsort(-margins, kind="stable")[:2]
            family, score = self.families[best], sure(margins[best] - margins[second])
        langs = self.members[family]
        wins, totals = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        found = {}
        for a, b in combinations(langs, 2):
            m = found[a, b] = float(self.by_pair[a, b] @ x)
            wins[a if m > 0 else b] += 1
            totals[a] += m
            totals[b] -= m
        lang = max(langs, key=lambda k: (wins[k], totals[k]))
        for (a, b), m in found.items():
            if lang in (a, b):
                score = min(score, sure(m if lang == a else -m))
        return lang, float(score)


def fit(labels: list[str], x: np.ndarray) -> Model | None:
    """The machines for rows of vectors; None without a row."""
    if not labels:
        return None
    langs = sorted(set(labels))
    members: dict[str, list[str]] = {}
    for k in langs:
        members.setdefault(FAMILY.get(k, k), []).append(k)
    families, label = sorted(members), np.array(labels)
    of = np.array([FAMILY.get(k, k) for k in labels])
    by_family = np.array([train_svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((1, x.shape[1] + 1))
    by_pair = {}
    for own in members.values():
        for a, b in combinations(own, 2):
            rows = (label == a) | (label == b)
            by_pair[a, b] = train_svm(x[rows], np.where(label[rows] == a, 1.0, -1.0))
    means = {k: x[label == k].mean(0) for k in langs}
    centres = {k: v / max(float(np.linalg.norm(v)), 1e-9) for k, v in means.items()}
    return Model(families, members, by_family.astype(np.float32), {k: w.astype(np.float32) for k, w in by_pair.items()}, centres)


def limits(labels: list[str], x: np.ndarray) -> tuple[float, float]:
    """The least margin and cosine of a text that counts as identified, from rows that the machines have not seen."""
    half, found = np.arange(len(labels)) % 2 == 0, []
    for own in (half, ~half):
        model = fit([k for k, o in zip(labels, own, strict=True) if o], x[own])
        found += [model.inside(v, model.predict(v)[0]) for v in x[~own]] if model else []
    if not found:
        return -np.inf, -np.inf
    margins, cosines = (np.percentile(v, CLEAN, method="lower") for v in np.array(found).T)
    return max(0.0, float(margins)) * MARGIN_SHARE, float(cosines) * COSINE_SHARE


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """The model of docs' labelled rows that are not held out. At most `per_language` rows of each language are used."""
    return fit(*sample_of(docs, per_language))


def sample_of(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Labels and vectors of the rows to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, 1.2 * per_language / n) * 1_000_000)).otherwise(share)
    picked = known.where(place < share).select("lang", place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                p = b.slice(at, 512)
                texts = p.column("text").cast(pa.binary()).to_pylist()
                kept = [has_letter(t) for t in texts]
                x = [vector(t).tobytes() if k else None for t, k in zip(texts, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([p.column("lang"), p.column("place"), p.column("doc_id"), pa.array(x, pa.binary())], ["lang", "place", "doc_id", "x"])

    rows = picked.mapInArrow(run, "lang string, place long, doc_id long, x binary").where("x is not null")
    rows = rows.orderBy("place", "doc_id").limit(2 * per_language * len(counts)).collect()
    used: dict[str, int] = {}
    kept = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["doc_id"] or 0, bytes(r["x"]))):
        used[r["lang"]] = used.get(r["lang"], 0) + 1
        if used[r["lang"]] <= per_language:
            kept.append(r)
    return [r["lang"] for r in kept], np.array([np.frombuffer(r["x"], np.float32) for r in kept]).reshape(-1, BUCKETS)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no row had a label. Only the text
    is read for a prediction, very long ones whole. Of equal votes the language with the larger sum of margins wins, then the
    first by name; of equal families the first by name. Repeated rows each keep a row; a null doc_id is not held out; extra
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in raw_texts(batches, "doc_id"):
            found = [model.predict(vector(t)) if model and has_letter(t) else (UNKNOWN, 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose text is in a learned language; columns as given, no shuffle.

    Texts without a letter go, those with a lower score than `least`, and those that lie less far inside their winner than
    `limits` allows: other languages, nonsense, and texts on the boundary.
    """
    labels, x = sample_of(docs)
    model, (margin, cosine) = fit(labels, x), limits(labels, x)

    def known(text: bytes) -> bool:
        if model is None or not has_letter(text):
            return False
        v = vector(text)
        lang, score = model.predict(v)
        m, c = model.inside(v, lang)
        return score >= least and m >= margin and c >= cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array([known(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
