"""Toxicity: cumulative-link ordinal regression on sparse text features.

The grade of a text, 0 to the highest label, follows P(grade <= k) = logistic(threshold_k - w x): one weight
vector for all thresholds, which stay in order because they are sums of positive steps. x marks which features
a text holds: its words (runs of letters in lower case, however long) and their beginnings of 3 to
``LONGEST_START`` letters, each by a hash of ``BITS`` bits, so that the model has one size whatever the words.
All features take part; x is the larger the more the grades of the documents that hold a feature differ from all
others' (by the G statistic, (G / (G + ``HALF_G``)) squared), so that the penalty weighs most on those that tell
little. Fitted on ``SAMPLE`` labelled documents about, chosen by a hash of the id; that is the documented bound.
All texts are scored whole.

Defined results: a null text or one without words holds no feature and has the grade of that; labels that are
null, and labels without a document, teach nothing; without any label the grade is 0 everywhere; of repeated
labels each counts; repeated rows give repeated rows; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

SAMPLE = 8_000
BITS = 20
HALF_G = 15.0
LONGEST_START = 6
PENALTY = 1e-4
STEPS = 100
LEAST_SEVERITY = 0.4
CACHE = 200_000
CACHED_BYTES = 256

_LETTERS = regex.compile(r"\p{L}+")


def features_of(token: bytes) -> list[str]:
    """The features of a stretch without white space."""
    out = []
    for word in _LETTERS.findall(token.decode("utf-8", "replace").lower()):
        out.append(word)
        out += ["^" + word[:k] for k in range(3, min(LONGEST_START, len(word)) + 1)]
    return out


def feature_number(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) >> (64 - BITS)


class Known(dict):
    """Numbers of the features of stretches; forgotten when too many, and not kept of long stretches."""

    def __missing__(self, token: bytes) -> np.ndarray:
        found = np.array([feature_number(f) for f in features_of(token)], np.int32)
        if len(token) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[token] = found
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Each feature once, in order."""
        found = [self[token] for token in set(text.split())]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grade_shares(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = k) of each score."""
    below = _logistic(thresholds[None, :] - score[:, None])
    edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
    return np.diff(edges, axis=1)


def telling(row: np.ndarray, column: np.ndarray, grades: np.ndarray, n_features: int) -> np.ndarray:
    """The G statistic of each feature: how far the grades of the documents that hold it are from those of all."""
    total, held = len(grades), np.bincount(column, minlength=n_features).astype(float)
    g = np.zeros(n_features)
    log = lambda a, b: a * np.log(np.where(a > 0, a, 1) / np.where(a > 0, np.maximum(b, 1e-300), 1))
    for grade in np.unique(grades):
        of = grades == grade
        share = of.mean()
        here = np.bincount(column[of[row]], minlength=n_features).astype(float)
        g += log(here, held * share) + log(of.sum() - here, (total - held) * share)
    return np.maximum(2 * g, 0)


def fit(row: np.ndarray, column: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, steps: int = STEPS, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """row, column: which document holds which feature; size: what x is for each feature held, 1 if not given.
    Returns weights (of features held or not) and thresholds; Adam on the penalised mean log likelihood."""
    size = np.ones(n_features) if size is None else size
    counts = np.bincount(grades, minlength=n_grades)
    before = np.clip(np.cumsum(counts)[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(before / (1 - before))
    theta = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n, last = len(grades), n_grades - 1
    for t in range(1, steps + 1):
        w, steps_up = theta[:n_features], np.exp(theta[n_features + 1 :])
        thresholds = theta[n_features] + np.concatenate([[0.0], np.cumsum(steps_up)])
        score = np.bincount(row, (w * size)[column], n)
        high = np.where(grades < last, _logistic(thresholds[np.minimum(grades, last - 1)] - score), 1.0)
        low = np.where(grades > 0, _logistic(thresholds[np.maximum(grades - 1, 0)] - score), 0.0)
        share = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / share, low * (1 - low) / share
        gradient = np.zeros_like(theta)
        gradient[:n_features] = np.bincount(column, (d_high - d_low)[row], n_features) * size / n + PENALTY * w
        by_threshold = -(np.bincount(np.minimum(grades, last - 1), np.where(grades < last, d_high, 0), last) - np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0), last)) / n
        gradient[n_features] = by_threshold.sum()
        gradient[n_features + 1 :] = np.cumsum(by_threshold[::-1])[::-1][1:] * steps_up
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    thresholds = theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])
    return theta[:n_features] * size, thresholds


def _held(df: DataFrame) -> DataFrame:
    """grade, text -> grade, held: the numbers of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [known.of(t or b"") for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"grade": part.column(0), "held": pa.array(held, pa.list_(pa.int32()))})

    return df.select("grade", "text").mapInArrow(run, "grade int, held array<int>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature number, and thresholds. Grades are whole numbers from 0."""
    ws = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(labels[id_col].alias("id"), labels[grade_col].cast("int").alias("grade")).filter("id is not null and grade >= 0")
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(-(-(sample << 20) // total)))
    known = ws.keep(known, "known")
    texts = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    graded = _held(texts.join(known, F.col("doc") == F.col("id")).select("grade", "text")).toArrow().combine_chunks()
    grades = graded.column("grade").to_numpy().astype(np.int64)
    if not len(grades) or grades.max() == 0:
        return np.zeros(1 << BITS), np.full(1, 30.0)
    held = pa.concat_arrays(graded.column("held").chunks)
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    column, row = held.flatten().to_numpy(), np.repeat(np.arange(len(grades)), sizes)
    g = telling(row, column, grades, 1 << BITS)
    return fit(row, column, grades, 1 << BITS, int(grades.max()) + 1, size=(g / (g + HALF_G)) ** 2)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity (the expected grade), grade (the likeliest), toxic (severity of ``LEAST_SEVERITY`` or more)."""
    w, thresholds = train(docs, labels, id_col, text_col, grade_col, sample)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((w, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, thresholds = model.value
        known = Known()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 256):
                for k, text in enumerate(pc.cast(batch.column(1).slice(at, 256), pa.binary()).to_pylist()):
                    score[at + k] = w[known.of(text or b"")].sum()
            shares = grade_shares(score, thresholds)
            severity = shares @ np.arange(shares.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(shares.argmax(axis=1), pa.int64()), pa.array(severity >= LEAST_SEVERITY)], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, severity double, grade long, toxic boolean")
