"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w.x) with one weight vector over hashed
text features shared by all grades, and ordered thresholds (each is the one
before plus a positive step). It gives an expected grade and, for selection, the
tail probability of the top part of the scale.

Features are hashed words, letter-case and punctuation shapes, repeats of the
word before, and a length class, each weighted by the root of its share of the
text, so that a text's length alone does not set its score.

Training takes at most ``MAX_TRAIN`` rated documents, chosen by a hash of doc_id
over all of them outside the held-out fold.

Defined cases: a null or empty text has only its length class; with fewer than
two grades every text gets the known grade (0 without any) with probability 1;
repeated rows get equal scores, and of repeated ratings of one doc_id the least
counts; rows of null grade are not learned from; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, bounded_sample, held_out

BUCKETS = 1 << 16
MAX_TRAIN = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.3
PENALTY = 1e-5
MIN_TAIL = 0.5
REMEMBERED = 400_000

_RUNS = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"\d+"), "0"))


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(word: str) -> str:
    """Kinds of the runs in a word; one leading capital is set apart from all capitals."""
    first = "C" if word[:1].isupper() and not word[1:2].isupper() else ""
    for pattern, kind in _RUNS:
        word = pattern.sub(kind, word)
    return first + word[:8]


class _Features(dict):
    """Buckets of a word and of its shape, packed in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = packed = _bucket("w" + word.lower().strip(".,;:!?")) | _bucket("s" + _shape(word)) << 16
        return packed


_features = _Features()
_REPEAT = _bucket("repeats the word before")


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a text, ascending, and their weights."""
    words = (text or "").split()
    packed = np.fromiter(map(_features.__getitem__, words), np.int64, len(words))
    repeats = np.count_nonzero(packed[1:] == packed[:-1])
    length = _bucket(f"length {len(words).bit_length()}")
    every = np.concatenate([packed & 0xFFFF, packed >> 16, np.full(repeats, _REPEAT)])
    found, n = np.unique(every, return_counts=True)
    weights = np.sqrt(n / max(1, len(words)))
    return np.append(found, length), np.append(weights, 1.0)


class CumulativeLink:
    """Shared weights and ordered thresholds of the grades 0 .. grades-1."""

    def __init__(self, grades: int) -> None:
        self.weights = np.zeros(BUCKETS)
        self.first = 0.0
        self.steps = np.zeros(max(0, grades - 2))  # logarithms of the gaps between thresholds

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def gradients(self, texts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """Of the mean negative log likelihood: features with their weights' gradients, and those of the first threshold and of the steps."""
        features, values = (np.concatenate([t[j] for t in texts]) for j in (0, 1))
        row = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        line = np.bincount(row, self.weights[features] * values, len(texts))
        below = 1 / (1 + np.exp(np.clip(line[:, None] - self.thresholds, -35, 35)))
        edges = np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1)
        slopes = edges * (1 - edges)
        at = np.arange(len(texts))
        p = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-9) * len(texts)
        up, down = slopes[at, grades + 1] / p, slopes[at, grades] / p
        touched, inverse = np.unique(features, return_inverse=True)
        by_weight = np.bincount(inverse, (up - down)[row] * values)
        by_threshold = np.zeros(len(self.steps) + 1)
        low, high = grades <= len(self.steps), grades > 0
        np.add.at(by_threshold, grades[low], -up[low])
        np.add.at(by_threshold, grades[high] - 1, down[high])
        return touched, by_weight, float(by_threshold.sum()), np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(self.steps)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> CumulativeLink:
        """Adagrad on the negative log likelihood of the grades."""
        share = np.cumsum(np.bincount(grades, minlength=len(self.steps) + 2))[:-1] / len(grades)
        start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        self.first, self.steps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
        rng = np.random.default_rng(seed)
        square, first_square, step_square = np.full(BUCKETS, 1e-6), 1e-6, np.full_like(self.steps, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for begin in range(0, len(order), BATCH):
                some = order[begin : begin + BATCH]
                touched, grad, first_grad, step_grad = self.gradients([texts[k] for k in some], grades[some])
                grad = grad + PENALTY * self.weights[touched]
                square[touched] += grad**2
                self.weights[touched] -= RATE * grad / np.sqrt(square[touched])
                first_square += first_grad**2
                self.first -= RATE * first_grad / np.sqrt(first_square)
                step_square += step_grad**2
                self.steps = np.clip(self.steps - RATE * step_grad / np.sqrt(step_square), -6, 6)
        return self

    def tails(self, text: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade > k) for each threshold."""
        line = self.weights[text[0]] @ text[1]
        return 1 / (1 + np.exp(np.clip(self.thresholds - line, -35, 35)))


class ConstantGrade:
    def __init__(self, tails: np.ndarray) -> None:
        self.fixed = tails

    def tails(self, text: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.fixed


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashed(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), batch.column("grade"), pa.array([f for f, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "features", "weights"])


def train(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[int], CumulativeLink | ConstantGrade]:
    """The grades seen, ascending, and a model of their places. ratings: (doc_id, grade)."""
    bound_batches(docs.sparkSession)
    marks = ratings.select(F.col("doc_id").cast("long").alias("rated_id"), F.col("grade").cast("int")).where(F.col("rated_id").isNotNull() & F.col("grade").isNotNull())
    marks = marks.where(~held_out(F.col("rated_id"))).groupBy("rated_id").agg(F.min("grade").alias("grade"))
    sample = bounded_sample(marks, "rated_id", max_train)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The right side holds at most max_train rows of two integers.
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id")).select("doc_id", "grade", "text")
    got = rows.mapInArrow(_feature_batches, "doc_id long, grade int, features array<long>, weights array<double>").toArrow().sort_by([("doc_id", "ascending")])
    grade = got.column("grade").to_numpy()
    known = sorted(set(grade.tolist()))
    if len(known) < 2:
        return known or [0], ConstantGrade(np.zeros(0))
    texts = [(np.asarray(f.values.to_numpy()), np.asarray(w.values.to_numpy())) for f, w in zip(got.column("features"), got.column("weights"), strict=True)]
    return known, CumulativeLink(len(known)).fit(texts, np.searchsorted(known, grade))


def _grade_batches(shared, min_grade: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        steps = np.diff(known)
        place = len(known) - 1 if min_grade is None else int(np.searchsorted(known, min_grade))
        for batch in batches:
            tails = [model.tails(hashed(t)) for t in batch.column("text").to_pylist()]
            expected = [float(known[0] + steps @ t) for t in tails]
            top = [1.0 if place == 0 else 0.0 if place > len(t) else float(t[place - 1]) for t in tails]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(expected, pa.float64()), pa.array(top, pa.float64())], ["doc_id", "held_out", "expected_grade", "tail_probability"])

    return grade


def grade_documents(docs: DataFrame, ratings: DataFrame, min_grade: int | None = None, min_tail: float = MIN_TAIL, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, expected_grade, tail_probability, kept)`` of every row of docs.

    The tail is the probability of at least min_grade (None: the highest grade); kept rows have at least min_tail of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ratings, max_train))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    graded = rows.mapInArrow(_grade_batches(shared, min_grade), "doc_id long, held_out boolean, expected_grade double, tail_probability double")
    return graded.withColumn("kept", F.col("tail_probability") >= min_tail)
