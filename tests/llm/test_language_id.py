import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from latentspark.llm import language_id
from latentspark.llm.common import load
from tests.llm.fixtures import DOCS, documents, frame

SF = "/root/testdata/sf0.01"


def brute_ranks(text, profile):
    text = (text or "").lower()
    text = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    text = " " + " ".join(text.split(" ")).strip() + " "
    while "  " in text:
        text = text.replace("  ", " ")
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return []
    n = Counter(text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1))
    del n[" "]

    def code(gram):
        return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))

    return sorted(n, key=lambda g: (-n[g], code(g)))[:profile]


def test_ranks_match_brute_force():
    for r in documents():
        codes = language_id.ranked(*language_id.gram_counts(language_id.normal_codes(r[1])), 400)
        grams = ["".join(chr(c >> 21 * i & 0x1FFFFF) for i in (2, 1, 0) if c >> 21 * i) for c in codes.tolist()]
        assert grams == brute_ranks(r[1], 400)


def test_out_of_place_distance():
    texts = {"en": "the cat and the dog and the bird", "de": "der hund und die katze und der vogel"}
    learned = {x: language_id.ranked(*language_id.gram_counts(language_id.normal_codes(t)), 50) for x, t in texts.items()}
    profiles = language_id.Profiles(learned, 50)
    for text in ("the dog", "und der hund", "vogel", "zzz"):
        mine, distance = brute_ranks(text, 50), {}
        for x, t in texts.items():
            theirs = brute_ranks(t, 50)
            distance[x] = sum(abs(i - theirs.index(g)) if g in theirs else 50 for i, g in enumerate(mine)) / (50 * len(mine))
        best = min(sorted(distance), key=distance.get)
        lang, score = profiles.predict(text)
        assert lang == best and np.isclose(score, 1 - distance[best])


def test_held_out_accuracy(spark):
    docs = load(spark, SF, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_outside_the_held_out_fold_only(spark):
    docs = load(spark, SF, "documents")
    marked = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'wrong' ELSE lang END AS lang")
    assert language_id.identify(marked).where("lang_pred = 'wrong'").count() == 0


def test_awkward_rows(spark):
    rows = documents()
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r.lang_pred == "und" for r in got) == 4
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = language_id.keep_identified(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len(rows) - 4


def test_no_language_learned_and_empty_table(spark):
    rows = [(i, "some words here", None, "a", 0) for i in range(4)]
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"und"}
    assert language_id.identify(frame(spark, rows).where("false")).count() == 0


def test_a_training_task_hands_on_every_ngram():
    text = "".join(chr(0x4E00 + int(x)) for x in np.random.default_rng(0).integers(0, 20_000, 15_000))
    expected = len(language_id.gram_counts(language_id.normal_codes(text))[0])
    got = list(language_id._count_batches(iter([pa.RecordBatch.from_pydict({"lang": ["zh"], "text": [text]})])))
    assert sum(b.num_rows for b in got) == expected > 20_000


def test_marks_and_digits_alone_are_no_language(spark):
    texts = ["the dog and the cat", "\u0301", "\u0301 12 \u0308", "12", "\u00e9", "e\u0301"]
    rows = [(4 * i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[4 * i][0] for i in range(len(texts))] == ["en", "und", "und", "und", "en", "en"]
    assert all(s == 0 for x, s in got.values() if x == "und")


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the cat and the dog", "en", "a", 0) for i in range(4000)] + [(4000 + i, "der hund und die katze", "de", "a", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    assert language_id._sample(docs, 100).groupBy("lang").count().orderBy("lang").collect() == [("de", 4), ("en", 100)]
    order = sorted(range(4000), key=lambda i: hashlib.md5(f"sample:{i}".encode()).hexdigest())
    for most in (1, 37, 100, 3999, 5000):
        got = language_id._sample(docs, most).where("lang = 'en'").collect()
        assert sorted(r.doc_id for r in got) == sorted(order[:most])
    assert language_id.identify(docs, max_train=100).where("doc_id >= 4000 AND lang_pred = 'de'").count() == 4


def test_a_very_long_text(spark):
    rows = [(0, "der hund und die katze " * 100_000, "de", "a", 0), (1, "the cat and the dog", "en", "a", 0), (4, "the dog", "en", "a", 0), (3, "\u6f22" * 1_000_000, "zh", "a", 0)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.lang_pred in ("de", "en", "zh", "und") for r in got) and len(got) == 4
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id == 0} == {0: "de"}
