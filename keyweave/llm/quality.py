"""A quality classifier by regularised quadratic discriminant analysis (operator 5).

Each document becomes a few transformed statistics of its text. For either class, mean and covariance come from sums
over all labelled training rows (counts, sums and products, added up in Spark; no row leaves its executor), and the
covariance is shrunk towards its diagonal and a ridge. A score is the logistic of the log-density difference of the
two Gaussians plus the log-odds of the classes; the densities use the Mahalanobis distance by Cholesky factors, which
are computed once and sent with the task.

Labels, language, source and ids are never features. Rows whose crc32(id as text) mod 5 is 0 are held out of training.

Defined results: a null or empty text has the statistics of no words and gets a score like any other; a null id counts
as the empty text in the split; repeated label rows count as often as they occur, null labels not at all; where a class
has no training row, every score is the share of the other class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, byte_class, pieces, prepared, word_hashes

#: Shares of the diagonal and of the identity (times the mean variance of both classes) in a covariance.
SHRINK, RIDGE = 0.2, 0.05
#: Words of a usual kind that count with those of a text, so that shares in very short texts don't jump.
PRIOR = 15.0
_UPPER = byte_class(lambda b: 65 <= b <= 90)
_LETTER = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_DIGIT = byte_class(lambda b: 48 <= b <= 57)
_STOP = byte_class(lambda b: b in b".,;:?")
_SYMBOL = byte_class(lambda b: 33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b".,;:?'\"-()"))
_NEWLINE = byte_class(lambda b: b == 10)
_BLANK = byte_class(lambda b: b == 32 or 9 <= b <= 13)
_CORE = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
FEATURES = ("symbols", "capitals", "digits", "stops", "newlines", "repeats", "variety", "shorts", "length", "words")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, ends = batch_bytes(texts)
    n = len(ends)
    starts = np.append(0, ends)[:-1]
    bytes_of = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(starts, ends, strict=True)], dtype=float).reshape(n, 256)
    symbols, capitals, letters, digits, stops, lines, blanks = (bytes_of @ which.astype(float) for which in (_SYMBOL, _UPPER, _LETTER, _DIGIT, _STOP, _NEWLINE, _BLANK))
    core, at, stop, of = word_hashes(data, ends, _CORE)
    cores = np.bincount(of, minlength=n).astype(float)
    again = (core[1:] == core[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[1:][again], minlength=n)
    keys = np.sort((of.astype(np.uint64) << np.uint64(40)) | (core >> np.uint64(24)))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    shorts = np.bincount(of[(stop - at) <= 3], minlength=n)
    core_bytes = np.bincount(of, weights=stop - at, minlength=n)
    w, c = blanks + 1 + PRIOR, cores + PRIOR
    return np.column_stack(
        [
            np.minimum(np.sqrt(symbols / w), 1.5),
            np.sqrt((capitals + 0.05 * PRIOR) / (letters + PRIOR)),
            np.minimum(np.sqrt(digits / w), 1.5),
            np.minimum(np.sqrt((stops + 0.2 * PRIOR) / w), 1.5),
            np.minimum(np.sqrt(lines / w), 1),
            np.sqrt(repeats / c),
            np.log((distinct + PRIOR) / c) / np.log(c + 2),
            np.sqrt((shorts + 0.4 * PRIOR) / c),
            np.log((core_bytes + 5 * PRIOR) / c),
            np.log(c) / 5,
        ]
    )


class Gaussian(NamedTuple):
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor of the covariance
    log_scale: float  # log prior minus half the covariance's log-determinant


class Model(NamedTuple):
    classes: tuple[Gaussian | None, Gaussian | None]  # label 0, label 1
    prior: float  # share of label 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not all(self.classes):
            return np.full(len(x), self.prior)
        zero, one = (g.log_scale - 0.5 * (((x - g.mean) @ g.factor.T) ** 2).sum(axis=1) for g in self.classes)
        return 1 / (1 + np.exp(np.clip(zero - one, -700, 700)))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Class means and covariances from all labelled rows outside the held-out fold."""
    d = len(FEATURES)
    prepared(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = statistics(batch["text"])
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, d, dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch["id"], lists], ["id", "x"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = batch["x"].flatten().to_numpy().reshape(-1, d), batch["y"].to_numpy()
            for label in (0, 1):
                part = x[y == label]
                total[label] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_pydict({"label": [0, 1], "sums": total.tolist()}, schema=pa.schema([("label", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    training = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # statistics first: what is shuffled to the labels is then ten numbers a row, not texts
    measured = training.mapInArrow(measure, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>")
    rows = measured.join(marked, "id").select("x", "y")
    parts = rows.mapInArrow(sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("k", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():  # two vectors of fixed length
        total[r["label"], r["k"]] = r["v"]
    return from_sums(total)


def from_sums(total: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    d = len(FEATURES)
    counts = total[:, 0]
    if not counts.sum():
        return Model((None, None), 0.5)
    prior = float(counts[1] / counts.sum())
    if not counts.all():
        return Model((None, None), prior)
    means = [t[1 : 1 + d] / t[0] for t in total]
    covariances = [t[1 + d :].reshape(d, d) / t[0] - np.outer(m, m) for t, m in zip(total, means, strict=True)]
    pooled = np.mean([np.trace(c) for c in covariances]) / d
    found = []
    for share, mean, raw in zip((1 - prior, prior), means, covariances, strict=True):
        shrunk = (1 - shrink) * raw + shrink * np.diag(np.diag(raw)) + max(ridge * pooled, 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        found.append(Gaussian(mean, np.linalg.inv(lower), float(np.log(share) - np.log(np.diag(lower)).sum())))
    return Model((found[0], found[1]), prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted) of every row, and the columns named in keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = pa.array(model.scores(statistics(batch["_text"])), pa.float64())
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), scores], [*rest, "_score"])

    prepared(docs.sparkSession)
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    scored = rows.mapInArrow(run, f"{schema}, _score double")
    predicted = F.when(F.col("_score") >= threshold, 1).otherwise(0)
    return scored.select(id_col, *keep, held_out(id_col).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows predicted to be good, with all their columns; null and empty texts are scored like others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.scores(statistics(batch["text"])) >= threshold))

    prepared(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kept = packed.mapInArrow(run, packed.schema)
    return kept.select(*(F.col("text" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns))
