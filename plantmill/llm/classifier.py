"""Quality classifier: a regularised quadratic discriminant over statistics of whole texts.

A text becomes ten numbers: shares of symbols, capitals, exclamations, digits, punctuation, words equal to the one before,
repeated lines and repeated word triples, each as a smoothed log odds (so that a short text, which says little, lies near
the middle), and the logs of mean word and line length. Each class has its mean and a covariance that is drawn to the
pooled variances, the more the fewer rows it has. A score is the probability of label 1 by the two normal densities and
the classes' shares: the difference of Mahalanobis distances and log determinants, from Cholesky factors found once.

Texts are read once: the statistics go to the shared folder, moments of the classes are added up per task and then per
position, and only these sums (two times 111 numbers) reach the driver. All labelled rows count; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.llm.common import cut, raw_texts, summed

SIZE, STRENGTH, LEAST, CHUNK = 10, 50.0, 0.3, 1 << 20
# ASCII white space, and punctuation of plain prose.
SPACES, PLAIN = [9, 10, 11, 12, 13, 32], [ord(c) for c in ",.:;'\"-()"]


def _log_odds(k: float, total: float, prior: float) -> float:
    return float(np.log((k + prior) / (max(total - k, 0) + 20 * prior)))


def statistics(text: bytes) -> list[float]:
    """The ten numbers of a UTF-8 text."""
    b, c = np.frombuffer(text, np.uint8), np.zeros(256, np.int64)
    for at in range(0, len(b), CHUNK):  # bincount copies to eight bytes an entry
        c += np.bincount(b[at : at + CHUNK], minlength=256)
    upper, lower, digit, loud, space, plain = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[33] + c[63], c[SPACES].sum(), c[PLAIN].sum()
    symbols = len(b) - upper - lower - digit - loud - space - plain - c[128:].sum()
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, m = len(words), len(lines)
    same = sum(map(bytes.__eq__, words, words[1:]))
    triples = max(n - 2, 0) - len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        _log_odds(symbols, len(b), 1), _log_odds(upper, upper + lower, 1), _log_odds(loud, n, 0.5), _log_odds(digit, len(b), 0.5), _log_odds(plain, n, 0.5),
        _log_odds(same, n, 0.5), _log_odds(m - len(set(lines)), m, 0.5), _log_odds(triples, n, 0.5),
        float(np.log((len(b) - space + 5) / (n + 1))), float(np.log((len(b) + 50) / (m + 1))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double>: the statistics of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in raw_texts(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Classes 0 and 1 as mean, inverse of the Cholesky factor, and the constant of the log density with the class's share."""

    classes: list[tuple[np.ndarray, np.ndarray, float]]
    known: float  # the score where a class has no row

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.known)
        zero, one = (c - 0.5 * np.square((x - m) @ inverse.T).sum(1) for m, inverse, c in self.classes)
        return 1 / (1 + np.exp(np.clip(zero - one, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Per class: rows, sums and sums of products of x, flat. labelled(quality, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, SIZE), np.array(b.column("quality").to_pylist())
            for k in (0, 1):
                own = x[y == k]
                sums[k] = sums.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["quality", "v"])

    return {k: v for (k,), v in summed(labelled.mapInArrow(run, "quality int, v array<double>"), ["quality"]).items() if v[0] > 0}


def fit(sums: dict[int, np.ndarray], strength: float = STRENGTH) -> Model:
    """The discriminant of the classes' moments. With rows of one class only every score is that class, without any row 0.5."""
    if len(sums) < 2:
        return Model([], float(next(iter(sums), 0.5)))
    total, out = sum(sums.values()), []
    spread = np.diag(total[1 + SIZE :].reshape(SIZE, SIZE)) / total[0] - np.square(total[1 : 1 + SIZE] / total[0])
    for k in (0, 1):
        n, mean = sums[k][0], sums[k][1 : 1 + SIZE] / sums[k][0]
        own, drawn = sums[k][1 + SIZE :].reshape(SIZE, SIZE) / n - np.outer(mean, mean), strength / (strength + n)
        factor = np.linalg.cholesky((1 - drawn) * own + np.diag(drawn * np.maximum(spread, 0) + 1e-6))
        out.append((mean, np.linalg.inv(factor), float(np.log(n / total[0]) - np.log(np.diag(factor)).sum())))
    return Model(out, 0.5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(found: DataFrame, labels: DataFrame, strength: float = STRENGTH) -> Model:
    """The model of `features` rows that have a label and are not held out.

    A doc_id with both labels counts once in each class, repeated labels count once, labels other than 0 and 1 and null
    ones not at all; repeated rows of a document count each.
    """
    own = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct().where(~held_out(F.col("doc_id")))
    return fit(moments(found.join(own, "doc_id").select("quality", "x")), strength)


def judge(docs: DataFrame, labels: DataFrame, strength: float = STRENGTH, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null and empty texts are scored by the statistics of an empty text; very long ones are read whole. Equal texts have
    equal scores, whatever their other columns. Repeated rows keep a row each; a null doc_id has no label and is not held
    out. Other columns are ignored, also those named like columns of the result; an empty table gives no row.
    """
    found = cut(features(docs))
    model = train(found, labels, strength)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    out = found.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
