"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of the embeddings of three hashed pieces: itself, its first
four and its first six letters. Filters over one, two and three words are
max-pooled over the whole text and feed a logistic output. As the filters are
linear before pooling, scoring looks up each piece's filter responses in one
table and adds them; long texts are scored by windows that overlap, so memory is
bounded by ``CHUNK`` words.

Training learns every labelled row outside the held-out fold. Up to ``MAX_PER_CLASS`` rows
of each class and ``MAX_TRAIN_WORDS`` words lie on the driver. More stay where they are: the
network starts from that many rows, chosen by a hash of doc_id (no text is cut), its score
corrected for the true share of toxic rows, and then goes ``PASSES`` times through all rows,
each task through its own and the weights they reach averaged by rows. Thresholds are calibrated by language on
a fifth of all those rows, which is kept from training; language never enters a score.

Defined cases: a null or empty text has no words and gets the score of an empty
text; with no labels of both classes every score is the share of toxic labels
(0 without labels); a language with under ``MIN_CALIBRATION`` calibration rows
takes the threshold of all; repeated rows get equal scores, and of repeated
labels of one doc_id the largest counts; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, bounded_sample, cut_lineage, held_out

BUCKETS = 1 << 15
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
PIECES = 3
MAX_PER_CLASS = 4000
EPOCHS = 8
BATCH = 64
#: Passes over all labelled rows where they are more than the driver takes, by at most so many tasks.
PASSES = 2
LEARNERS = 64
#: Labelled ids up to which they are sent to the texts; beyond it the texts are shuffled once.
MAX_SENT = 2_000_000
#: Words of a step of such a pass, at most; a longer text is a step of its own.
STEP_WORDS = 1 << 18
#: Parts of the score's range by which calibration rows are counted.
BINS = 100_000
RATE = 0.035
DECISION = 0.3
MIN_CALIBRATION = 60
#: Words of the training sample that reach the driver, eight bytes each.
MAX_TRAIN_WORDS = 1 << 24
CALIBRATION_PART = 5
CHUNK = 1 << 15
#: Words whose pieces a worker remembers.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W_]+")


class _Pieces(dict):
    """The hashed pieces of a word, packed in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = 0
        for at, piece in enumerate(("w" + word, "4" + word[:4], "6" + word[:6])):
            packed |= (zlib.crc32(piece.encode("utf-8", "surrogatepass")) % BUCKETS) << (16 * at)
        self[word] = packed
        return packed


_pieces = _Pieces()


def packed_words(text: str | None) -> np.ndarray:
    return np.fromiter(map(_pieces.__getitem__, _WORD.findall((text or "").lower())), np.int64)


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Bucket of each piece of each word, one column a piece."""
    return np.stack([(packed >> (16 * at)) & 0xFFFF for at in range(PIECES)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class ConvNet:
    """Embedding, filters of several widths, max pooling and a logistic output."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = 0.0

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best response of each filter to each text, the word at which its window begins (-1: none), and all texts' buckets and vectors.

        Texts lie one after another, and a window that would reach into the next one doesn't count; a text shorter than a
        filter is padded with nothing.
        """
        length = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(length)
        buckets = unpacked(np.concatenate([np.zeros(0, np.int64), *texts]))
        vectors = sum(self.embedding[buckets[:, at]] for at in range(PIECES))
        n, some = len(buckets), np.flatnonzero(length)
        starts, text_of, room = (end - length)[some], np.repeat(np.arange(len(texts)), length), np.repeat(end, length) - np.arange(n)
        values, places = (np.zeros((len(texts), FILTERS * len(WIDTHS)), t) for t in (vectors.dtype, np.int64))
        places -= 1
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            if n < w:
                continue
            response = np.full((n, FILTERS), -np.inf, vectors.dtype)
            inner = vectors[: n - w + 1] @ f[0]
            for j in range(1, w):
                inner += vectors[j : n - w + 1 + j] @ f[j]
            response[: n - w + 1] = inner
            response[room < w] = -np.inf
            best = np.maximum.reduceat(response, starts)
            full = np.zeros((len(texts), FILTERS), vectors.dtype)
            full[some] = best
            hit = (response == full[text_of]) & np.isfinite(response)
            for c in range(FILTERS):
                at = np.flatnonzero(hit[:, c])
                at = at[np.diff(text_of[at], prepend=-1) > 0]  # the first of each text
                values[text_of[at], i * FILTERS + c] = full[text_of[at], c]
                places[text_of[at], i * FILTERS + c] = at
        return values, places, buckets, vectors

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean logistic loss: by output weights, biases, output bias and filters, and touched buckets with theirs; only pooled windows carry any."""
        pooled, places, buckets, vectors = self.pooled(texts)
        live = pooled + self.bias
        hidden = np.maximum(live, 0)
        error = (_sigmoid(hidden @ self.out + self.out_bias) - labels) / len(texts)
        back = error[:, None] * self.out * (live > 0)
        by_filter, rows, parts = [np.zeros_like(f) for f in self.filters], [np.zeros((0, PIECES), np.int64)], [np.zeros((0, DIM), vectors.dtype)]
        for i, w in enumerate(WIDTHS):
            for c in range(FILTERS):
                column = i * FILTERS + c
                some = np.flatnonzero((back[:, column] != 0) & (places[:, column] >= 0))
                window = places[some, column][:, None] + np.arange(w)
                share = back[some, column][:, None, None]
                by_filter[i][:, :, c] = (share * vectors[window]).sum(axis=0)
                rows.append(buckets[window].reshape(-1, PIECES))
                parts.append((share * self.filters[i][None, :, :, c]).reshape(-1, DIM))
        every = np.concatenate(rows).ravel()
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=-1))
        touched, shares = every[order][first], np.concatenate(parts)[order // PIECES]
        by_bucket = np.add.reduceat(shares, first, axis=0) if len(first) else shares
        return error @ hidden, back.sum(axis=0), float(error.sum()), by_filter, touched, by_bucket

    def start(self) -> None:
        """Forgets the squared gradients by which steps shrink."""
        self.squares = [np.full_like(v, 1e-6) for v in (self.out, self.bias, *self.filters)]
        self.bias_square, self.bucket_squares = 1e-6, np.full_like(self.embedding, 1e-6)

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """A step of Adagrad on the logistic loss."""
        out, bias, out_bias, filters, touched, buckets = self.gradients(texts, labels)
        for grad, value, square in zip([out, bias, *filters], [self.out, self.bias, *self.filters], self.squares, strict=True):
            square += grad**2
            value -= RATE * grad / np.sqrt(square)
        self.bias_square += out_bias**2
        self.out_bias -= RATE * out_bias / np.sqrt(self.bias_square)
        self.bucket_squares[touched] += buckets**2
        self.embedding[touched] -= RATE * buckets / np.sqrt(self.bucket_squares[touched])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> ConvNet:
        rng = np.random.default_rng(seed)
        self.start()
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), BATCH):
                some = order[start : start + BATCH]
                self.step([texts[k] for k in some], labels[some])
        return self

    def weights(self) -> np.ndarray:
        return np.concatenate([np.ravel(v).astype(np.float32) for v in (self.out_bias, self.out, self.bias, *self.filters, self.embedding)])

    def with_weights(self, flat: np.ndarray) -> ConvNet:
        self.out_bias, at = float(flat[0]), 1
        for v in (self.out, self.bias, *self.filters, self.embedding):
            v[...] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return self

    def scorer(self, shift: float = 0.0) -> Scorer:
        return Scorer(self, shift)


class Scorer:
    """Filter responses of each bucket in one table, for whole texts of any length."""

    def __init__(self, net: ConvNet, shift: float) -> None:
        columns = [net.filters[i][j] for i, w in enumerate(WIDTHS) for j in range(w)]
        self.table = np.concatenate([net.embedding @ c for c in columns], axis=1)
        self.bias, self.out, self.out_bias = net.bias, net.out, net.out_bias + shift

    def score(self, packed: np.ndarray) -> float:
        best = np.full(len(self.out), -np.inf, np.float32)
        longest = max(WIDTHS)
        for start in range(0, len(packed), CHUNK):
            buckets = unpacked(packed[start : start + CHUNK + longest - 1])
            found = self.table[buckets[:, 0]]
            for at in range(1, PIECES):
                found += self.table[buckets[:, at]]
            column = 0
            for i, w in enumerate(WIDTHS):
                n = len(buckets) - w + 1
                if n > 0:
                    response = found[:n, column : column + FILTERS].copy()
                    for j in range(1, w):
                        response += found[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
                    mine = slice(i * FILTERS, (i + 1) * FILTERS)
                    best[mine] = np.maximum(best[mine], response.max(axis=0))
                column += w * FILTERS
        best[np.isneginf(best)] = 0
        return float(_sigmoid(np.maximum(best + self.bias, 0) @ self.out + self.out_bias))


class ConstantScorer:
    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, packed: np.ndarray) -> float:
        return self.value


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score, among those seen, from which flagging gives the best F1; of equal ones the middle of the gap below."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, labels.sum()))
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [packed_words(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "toxic")), pa.array(packed, pa.list_(pa.int64()))], ["doc_id", "lang", "toxic", "words"])


def _affordable(packed: DataFrame, max_words: int) -> DataFrame:
    """Ids of sampled texts, in the order of the sample's hash, as long as all their words fit; a text that doesn't is passed over."""
    order = F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    sizes = packed.groupBy("doc_id").agg(F.sum(F.size("words")).alias("n")).orderBy(order, "doc_id").collect()
    taken, total = [], 0
    for r in sizes:  # at most two times max_per_class ids
        if total + r.n <= max_words:
            taken.append((r.doc_id,))
            total += r.n
    return packed.sparkSession.createDataFrame(taken, "doc_id long")


def _is_apart(doc_id: int) -> bool:
    """Whether a labelled row is kept from training for the thresholds."""
    return zlib.crc32(str(doc_id).encode()) // 4 % CALIBRATION_PART == 0


def _steps(texts: list[np.ndarray], order: np.ndarray) -> Iterator[np.ndarray]:
    """order in runs of at most BATCH texts and STEP_WORDS words, or of one text."""
    start, words = 0, 0
    for at, k in enumerate(order):
        if at > start and (at - start == BATCH or words + len(texts[k]) > STEP_WORDS):
            yield order[start:at]
            start, words = at, 0
        words += len(texts[k])
    if len(order):
        yield order[start:]


def _learned(net: ConvNet, rows: DataFrame, at: int) -> ConvNet:
    """net after a pass over rows (toxic, text): each task goes on from the same weights, and what they reach is averaged by rows."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, n = copy.deepcopy(sent.value), TaskContext.get().partitionId(), 0
        for k, batch in enumerate(batches):
            texts, toxic = [packed_words(t) for t in batch.column("text").to_pylist()], batch.column("toxic").to_numpy().astype(np.float32)
            for some in _steps(texts, np.random.default_rng([at, task, k]).permutation(len(texts))):
                own.step([texts[x] for x in some], toxic[some])
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "n": [n], "weights": [own.weights().tobytes()]})

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = 0.0, 0
        for batch in batches:
            for n, weights in zip(batch.column("n").to_pylist(), batch.column("weights"), strict=True):
                total, rows = total + n * np.frombuffer(weights.as_py(), np.float32).astype(float), rows + n
        if rows:
            yield pa.RecordBatch.from_pydict({"weights": [(total / rows).astype(np.float32).tobytes()]})

    # A network a task, at most LEARNERS of them, added in one order.
    parts = rows.coalesce(LEARNERS).mapInArrow(of_task, "task int, n long, weights binary")
    found = parts.repartition(1).sortWithinPartitions("task").mapInArrow(averaged, "weights binary").collect()
    sent.unpersist()
    return copy.deepcopy(net).with_weights(np.frombuffer(found[0].weights, np.float32)) if found else net


def _threshold_of_bins(bins: list) -> float:
    """best_threshold of counted scores (n, toxic, least, most)."""
    bins = sorted(bins, key=lambda r: -r.least)
    hits, n = np.cumsum([r.toxic for r in bins]), np.cumsum([r.n for r in bins])
    k = int(np.argmax(2 * hits / (n + max(1, hits[-1]))))
    return float((bins[k].least + (bins[k + 1].most if k + 1 < len(bins) else 0.0)) / 2)


def _calibrated(scorer: Scorer, rows: DataFrame) -> dict[str | None, float]:
    """Thresholds from all of rows (lang, toxic, text): counts of each part of the score's range reach the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(packed_words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(scores, pa.float64())], ["lang", "toxic", "score"])

    scored = cut_lineage(rows.select("lang", "toxic", "text").mapInArrow(score, "lang string, toxic int, score double"))
    counts = (F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("score").alias("least"), F.max("score").alias("most"))
    place = F.floor(F.col("score") * BINS).alias("bin")
    found = scored.groupBy(place).agg(*counts).collect()
    thresholds: dict[str | None, float] = {None: _threshold_of_bins(found) if found else DECISION}
    own = scored.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where((F.col("n") >= MIN_CALIBRATION) & F.col("t").between(1, F.col("n") - 1))
    by_lang: dict[str, list] = {}
    for r in scored.join(F.broadcast(own.select("lang")), "lang").groupBy("lang", place).agg(*counts).collect():
        by_lang.setdefault(r.lang, []).append(r)
    return thresholds | {lang: _threshold_of_bins(bins) for lang, bins in by_lang.items()}


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_words: int = MAX_TRAIN_WORDS) -> tuple[Scorer | ConstantScorer, dict[str | None, float]]:
    """A scorer and the threshold of each language (None: of all)."""
    bound_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int")).where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1))
    marks = cut_lineage(marks.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        return ConstantScorer(share), {None: DECISION}
    sample = bounded_sample(marks.where("toxic = 1"), "label_id", max_per_class).union(bounded_sample(marks.where("toxic = 0"), "label_id", max_per_class))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    # The right side holds at most two times max_per_class rows of two integers.
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "lang", "toxic", "text")
    packed_rows = cut_lineage(rows.mapInArrow(_pack_batches, "doc_id long, lang string, toxic int, words array<long>"))
    got = packed_rows.join(F.broadcast(_affordable(packed_rows, max_words)), "doc_id", "left_semi").toArrow().sort_by([("doc_id", "ascending")])
    whole = max(sizes.values()) <= max_per_class and got.num_rows == packed_rows.count()
    toxic = got.column("toxic").to_numpy()
    packed = [np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64) for x in got.column("words")]
    lang = got.column("lang").to_pylist()
    both = 0 < toxic.sum() < len(toxic)
    if whole and not both:  # no text of one class
        return ConstantScorer(share), {None: DECISION}
    apart = np.array([_is_apart(d) for d in got.column("doc_id").to_pylist()], bool)
    if not 0 < toxic[~apart].sum() < (~apart).sum():
        apart[:] = False
    learned = np.flatnonzero(~apart)
    net, shift = ConvNet(), 0.0
    net.start()
    if both:
        net.fit([packed[k] for k in learned], toxic[learned].astype(np.float32))
        seen = toxic[learned].mean()
        shift = float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    if not whole:
        net.out_bias += shift
        return _train_all(net, texts, marks, sum(sizes.values()))
    scorer = net.scorer(shift)
    held = np.flatnonzero(apart) if apart.any() else learned
    scores = np.array([scorer.score(packed[k]) for k in held])
    thresholds: dict[str | None, float] = {None: best_threshold(scores, toxic[held])}
    for x in sorted({lang[k] for k in held if lang[k] is not None}):
        own = np.array([lang[k] == x for k in held])
        if own.sum() >= MIN_CALIBRATION and 0 < toxic[held][own].sum() < own.sum():
            thresholds[x] = best_threshold(scores[own], toxic[held][own])
    return scorer, thresholds


def _train_all(net: ConvNet, texts: DataFrame, marks: DataFrame, n: int) -> tuple[Scorer | ConstantScorer, dict[str | None, float]]:
    """net gone through all labelled texts, and thresholds of all of them that are kept apart."""
    sent = n <= MAX_SENT
    rows = texts.join(F.broadcast(marks) if sent else marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "lang", "toxic", "text")
    if not sent:
        rows = cut_lineage(rows)
    apart = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % CALIBRATION_PART == 0
    sizes = {(r.apart, r.toxic): r["count"] for r in marks.select(F.col("label_id").alias("doc_id"), "toxic").groupBy(apart.alias("apart"), "toxic").count().collect()}
    kept = all(sizes.get((False, t)) for t in (0, 1)) and any(sizes.get((True, t)) for t in (0, 1))
    for at in range(PASSES):
        net = _learned(net, rows.where(~apart).select("toxic", "text") if kept else rows.select("toxic", "text"), at)
    scorer = net.scorer()
    return scorer, _calibrated(scorer, rows.where(apart) if kept else rows)


def _score_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, thresholds = shared.value
        for batch in batches:
            scores = [scorer.score(packed_words(t)) for t in batch.column("text").to_pylist()]
            limits = [thresholds.get(x, thresholds[None]) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(limits, pa.float64())], ["doc_id", "held_out", "score", "threshold"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, threshold, flagged)`` of every row; flagged uses the language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_per_class))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("lang").cast("string"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_score_batches(shared), "doc_id long, held_out boolean, score double, threshold double")
    return scored.withColumn("flagged", F.col("score") >= F.col("threshold"))
