import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.llm import quality, toxicity
from latentspark.llm.common import load
from tests.llm.fixtures import documents, frame

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_the_held_out_fold(spark):
    labels = load(spark, SF, "labels")
    got = toxicity.toxicity(load(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    truth, score = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    found = score >= toxicity.DECISION
    assert ((0 <= score) & (score <= 1)).all()
    assert (found & (truth == 1)).sum() / truth.sum() > 0.8
    assert (found & (truth == 1)).sum() / found.sum() > 0.9
    flagged = np.array([r.flagged for r in got])
    assert (flagged & (truth == 1)).sum() / flagged.sum() > 0.8


def test_words_of_the_sample_are_bounded(spark):
    """A labelled text of a million words is passed over; the others of the sample are learned from."""
    docs = [(i, f"{'vile' if i % 2 else 'kind'} word {i} " * 5, "en", "a", 0) for i in range(40)] + [(40, "long " * 1_000_000, "en", "a", 0)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(41)], LABELS)
    packed = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate((5, 3, 1000, 4))], "doc_id long, words array<long>")
    assert {r.doc_id for r in toxicity._affordable(packed, 12).collect()} == {0, 1, 3}
    scorer, _ = toxicity.train(frame(spark, docs), labels, max_words=2_000)
    assert scorer.score(toxicity.packed_words("vile word " * 5)) > scorer.score(toxicity.packed_words("kind word " * 5))


def test_every_labelled_row_is_learned_from(spark):
    """words and languages of rows beyond the sample's bounds shape the score and the thresholds."""
    # Each of 200 words tells alone; a sample of 20 rows a class has few of them.
    words = [hashlib.md5(str(k).encode()).hexdigest()[:9] for k in range(200)]
    docs = [(i, f"{words[i % 200]} of it", "en" if i % 3 else "de", "a", 0) for i in range(4_000)]
    labels = spark.createDataFrame([(i, 0, i % 200 % 2) for i in range(4_000)], LABELS)
    frames = frame(spark, docs, False), labels
    scorer, thresholds = toxicity.train(*frames, max_per_class=20)
    scores = np.array([scorer.score(toxicity.packed_words(f"{w} of it")) for w in words])
    assert np.mean((scores >= 0.5) == np.arange(200) % 2) > 0.95
    assert set(thresholds) == {None, "en", "de"}
    assert np.array_equal(toxicity.train(*frames, max_per_class=20)[0].table, scorer.table)


def test_steps_hold_bounded_words(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP_WORDS", 10)
    texts = [np.zeros(n, np.int64) for n in (4, 5, 6, 50, 1, 0, 9)]
    assert [s.tolist() for s in toxicity._steps(texts, np.arange(7))] == [[0, 1], [2], [3], [4, 5, 6]]
    assert [len(s) for s in toxicity._steps([np.zeros(0)] * 130, np.arange(130))] == [64, 64, 2] and not list(toxicity._steps([], np.arange(0)))


def test_thresholds_of_counted_scores_are_those_of_all(spark):
    rng = np.random.default_rng(0)
    scores, labels = rng.random(500).round(3), (rng.random(500) < 0.3).astype(int)
    table = spark.createDataFrame(list(zip(scores.tolist(), labels.tolist(), strict=True)), "score double, y int")
    bins = table.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"), F.min("score").alias("least"), F.max("score").alias("most")).collect()
    t = toxicity._threshold_of_bins(bins)
    f1 = lambda t: 2 * labels[scores >= t].sum() / ((scores >= t).sum() + labels.sum())
    assert f1(t) == pytest.approx(max(f1(x) for x in scores))


def test_scorer_table_matches_the_network():
    rng = np.random.default_rng(0)
    texts = [toxicity.packed_words(" ".join(rng.choice(["one", "two", "three", "four", "five"], n))) for n in (0, 1, 2, 3, 40)]
    net = toxicity.ConvNet().fit(texts, np.array([0, 1, 0, 1, 1], np.float32), epochs=2)
    scorer = net.scorer()
    for packed in texts:
        pooled = brute_pooled(net, packed)
        assert np.allclose(net.pooled([packed])[0][0], pooled, atol=1e-6)
        assert scorer.score(packed) == pytest.approx(float(toxicity._sigmoid(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)), abs=1e-5)


def brute_pooled(net, packed):
    """Best response of each filter by a loop over windows."""
    vectors = [sum(net.embedding[b] for b in row) for row in toxicity.unpacked(packed)] if len(packed) else []
    out = []
    for w, f in zip(toxicity.WIDTHS, net.filters, strict=True):
        for c in range(toxicity.FILTERS):
            found = [sum(vectors[k + j] @ f[j, :, c] for j in range(w)) for k in range(len(vectors) - w + 1)]
            out.append(max(found, default=0.0))
    return np.array(out)


def brute_score(net, packed):
    return float(toxicity._sigmoid(np.maximum(brute_pooled(net, packed) + net.bias, 0) @ net.out + net.out_bias))


def test_texts_of_a_batch_do_not_meet():
    rng = np.random.default_rng(1)
    net = toxicity.ConvNet(2)
    texts = [toxicity.packed_words(" ".join(rng.choice(list("abcdefgh"), n))) for n in (0, 1, 5, 0, 2, 30, 3, 0)]
    pooled = net.pooled(texts)[0]
    assert np.allclose(pooled, [brute_pooled(net, t) for t in texts], atol=1e-6)
    assert net.pooled([])[0].shape == (0, 24) and (net.pooled([texts[0]])[1] == -1).all()


def test_gradients_of_the_network_are_numerical_ones():
    rng = np.random.default_rng(2)
    texts = [toxicity.packed_words(" ".join(rng.choice(list("abcdef"), n))) for n in (1, 4, 0, 9, 2)]
    labels = np.array([1, 0, 1, 0, 1.0])
    net = toxicity.ConvNet(1)
    net.embedding, net.filters, net.bias, net.out = net.embedding.astype(float), [f.astype(float) for f in net.filters], rng.normal(0, 0.1, 24), net.out.astype(float)

    def loss():
        p = np.array([brute_score(net, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    out, bias, out_bias, filters, touched, buckets = net.gradients(texts, labels)

    def numerical(values, place):
        had, step = values[place], 1e-6
        values[place] = had + step
        up = loss()
        values[place] = had - step
        down = loss()
        values[place] = had
        return (up - down) / (2 * step)

    for c in range(24):
        assert out[c] == pytest.approx(numerical(net.out, c), abs=1e-6) and bias[c] == pytest.approx(numerical(net.bias, c), abs=1e-6)
    for f, grad in zip(net.filters, filters, strict=True):
        for place in [(j, d, c) for j in range(len(f)) for d in (0, 7) for c in range(8)]:
            assert grad[place] == pytest.approx(numerical(f, place), abs=1e-6)
    for k, b in enumerate(touched):
        assert buckets[k, 3] == pytest.approx(numerical(net.embedding, (b, 3)), abs=1e-6)
    net.out_bias += 1e-6
    up = loss()
    net.out_bias -= 2e-6
    assert out_bias == pytest.approx((up - loss()) / 2e-6, abs=1e-6)


def test_whole_query_against_a_plain_network(spark):
    """Every score of a small table by loops over words and windows, the network and its correction being the operator's."""
    rows = documents()
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], LABELS)
    docs = frame(spark, rows)
    scorer, thresholds = toxicity.train(docs, labels)
    got = sorted((str(r.doc_id), round(r.score, 4), r.flagged) for r in toxicity.toxicity(docs, labels).collect())
    column, net = 0, toxicity.ConvNet()
    net.bias, net.out, net.out_bias = scorer.bias, scorer.out, scorer.out_bias
    expected = []
    for doc_id, text, lang, *_ in rows:
        words = toxicity._WORD.findall((text or "").lower())
        table = [sum(scorer.table[zlib.crc32(p.encode()) % toxicity.BUCKETS] for p in ("w" + w, "4" + w[:4], "6" + w[:6])) for w in words]
        best, column = [], 0
        for width in toxicity.WIDTHS:
            windows = [sum(table[k + j][column + j * 8 : column + (j + 1) * 8] for j in range(width)) for k in range(len(words) - width + 1)]
            best.append(np.max(windows, axis=0) if windows else np.zeros(8))
            column += width * 8
        score = float(toxicity._sigmoid(np.maximum(np.concatenate(best) + scorer.bias, 0) @ scorer.out + scorer.out_bias))
        expected.append((str(doc_id), round(score, 4), score >= thresholds.get(lang, thresholds[None])))
    assert [x[0] for x in got] == [x[0] for x in sorted(expected)]
    assert all(abs(a[1] - b[1]) < 2e-4 for a, b in zip(got, sorted(expected), strict=True))


def test_very_long_texts_are_scored():
    net, words = toxicity.ConvNet(3), " ".join(f"w{k % 977}" for k in range(1_200_000))
    assert 0 <= net.scorer().score(toxicity.packed_words(words)) <= 1
    assert 0 <= net.scorer().score(toxicity.packed_words("x" * 2_000_000)) <= 1
    features, weights = quality.hashed(words)
    assert len(features) == len(weights) < quality.BUCKETS and np.isfinite(weights).all()
    assert len(quality.hashed("x" * 2_000_000)[0]) <= 4


def test_long_texts_score_by_overlapping_windows(monkeypatch):
    net = toxicity.ConvNet(3)
    packed = toxicity.packed_words(" ".join(f"w{k % 91}" for k in range(500)))
    whole = net.scorer().score(packed)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert net.scorer().score(packed) == pytest.approx(whole, abs=1e-6)


def test_threshold_of_best_f1():
    assert 0.4 < toxicity.best_threshold(np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])) < 0.8


def test_toxicity_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, 1, i % 3 == 0) for i in range(60)] + [(None, 1, True), (5, None, None), (6, 1, True), (6, 1, False)], "doc_id long, quality int, toxic boolean")
    got = toxicity.toxicity(frame(spark, rows), labels.withColumn("toxic", F.col("toxic").cast("int"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(frame(spark, rows), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, rows).where("false"), none).count() == 0


def test_quality_on_the_held_out_fold(spark):
    labels = load(spark, SF, "labels")
    graded = quality.grade_documents(load(spark, SF, "documents"), labels.select("doc_id", F.col("quality").alias("grade")))
    got = graded.join(labels, "doc_id").where("held_out").collect()
    truth, kept = np.array([r.quality for r in got]) == 1, np.array([r.kept for r in got])
    assert kept[truth].mean() > 0.97 and kept[~truth].mean() < 0.1


def test_cumulative_link_orders_four_grades():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(4))
        share = (g + rng.normal(0, 0.3)) / 4
        texts.append(quality.hashed(" ".join(rng.choice(["fine", "poor", "plain"], 60, p=np.array([max(0, share), max(0, 1 - share), 0.5]) / (max(0, share) + max(0, 1 - share) + 0.5)))))
        grades.append(g)
    model = quality.CumulativeLink(4).fit(texts[:1200], np.array(grades[:1200]))
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.array([model.tails(t) for t in texts[1200:]])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(axis=1), grades[1200:])[0, 1] > 0.85


@pytest.mark.parametrize("n", [2, 3, 5])
def test_gradients_of_the_likelihood_are_numerical_ones(n):
    rng = np.random.default_rng(n)
    texts = [quality.hashed(" ".join(rng.choice(list("abcdef"), k))) for k in (1, 5, 0, 9, 3, 7)]
    grades = rng.integers(0, n, 6)
    model = quality.CumulativeLink(n)
    model.first, model.steps = -0.4, rng.normal(size=n - 2) * 0.3
    used = np.unique(np.concatenate([t[0] for t in texts]))
    model.weights[used] = rng.normal(size=len(used)) * 0.3

    def loss():
        edges = np.array([[1, *model.tails(t), 0] for t in texts])
        return -np.log(edges[range(6), grades] - edges[range(6), grades + 1]).mean()

    touched, by_weight, by_first, by_step = model.gradients(texts, grades)

    def numerical(values, place):
        had = values[place]
        values[place] = had + 1e-6
        up = loss()
        values[place] = had - 1e-6
        down = loss()
        values[place] = had
        return (up - down) / 2e-6

    assert (touched == used).all()
    assert np.allclose(by_weight, [numerical(model.weights, k) for k in used], atol=1e-7)
    assert np.allclose(by_step, [numerical(model.steps, k) for k in range(n - 2)], atol=1e-7)
    model.first += 1e-6
    up = loss()
    model.first -= 2e-6
    assert by_first == pytest.approx((up - loss()) / 2e-6, abs=1e-7)


def test_gradient_of_the_likelihood(monkeypatch):
    """One full-batch step moves the loss down for any number of grades."""
    texts = [quality.hashed(t) for t in ("a b", "a", "b c", "c", "c c d")]
    grades = np.array([0, 0, 1, 2, 2])

    def loss(m):
        edges = np.array([[1, *m.tails(t), 0] for t in texts])
        return -np.log(edges[range(5), grades] - edges[range(5), grades + 1]).sum()

    monkeypatch.setattr(quality, "RATE", 0.02)
    losses = [loss(quality.CumulativeLink(3).fit(texts, grades, epochs=e)) for e in (0, 5, 50)]
    assert losses[0] > losses[1] > losses[2]


def test_grades_against_the_formula(spark):
    """Expected grade and tail of every row from the model's weights, feature by feature."""
    rows = documents()
    ratings = spark.createDataFrame([(i, 2 * (i % 4)) for i in range(60)], "doc_id long, grade int")
    known, model = quality.train(frame(spark, rows), ratings)
    assert known == [0, 2, 4, 6]
    got = sorted((str(r.doc_id), round(r.expected_grade, 6), round(r.tail_probability, 6), r.kept) for r in quality.grade_documents(frame(spark, rows), ratings, min_grade=3).collect())
    expected = []
    for doc_id, text, *_ in rows:
        line = sum(model.weights[f] * v for f, v in zip(*quality.hashed(text), strict=True))
        above = [1 / (1 + math.exp(t - line)) for t in model.thresholds]
        expected.append((str(doc_id), round(2 * sum(above), 6), round(above[1], 6), above[1] >= 0.5))  # at least 3 is at least 4
    assert got == sorted(expected)


def test_quality_awkward_rows(spark):
    rows = documents()
    ratings = spark.createDataFrame([(i, i % 4) for i in range(60)] + [(None, 1), (5, None), (6, 0), (6, 3)], "doc_id long, grade int")
    got = quality.grade_documents(frame(spark, rows), ratings, min_grade=2).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.expected_grade <= 3 and 0 <= r.tail_probability <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert {r.expected_grade for r in quality.grade_documents(frame(spark, rows), none).collect()} == {0.0}
    assert quality.grade_documents(frame(spark, rows).where("false"), none).count() == 0
