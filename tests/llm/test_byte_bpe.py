import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from latentspark.llm import byte_bpe, queries
from latentspark.llm.common import load
from tests.llm.fixtures import documents, frame

RANKS = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "b", "th", "e ", " ", "\n", "é", "漢", "1", "23", "'s", "'re", "!", "=", "　", "\x85", "the", "ing", "\U0001f600", "\x01", "\x02", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec(spark):
    return byte_bpe.public_codec(spark)


def texts() -> list[str | None]:
    rng = random.Random(1)
    found = ["hello world's   \n\n  x", "", None, "a" * 1000, "=-" * 300, " " * 5000 + "x", "漢" * 200, "the " * 20, "\x01 the\x02 11,12\x01"]
    found.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)))
    found.append("".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20_000)))
    found += ["".join(rng.choice([*PARTS, chr(rng.randint(32, 0x2FFF))]) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    return found


@pytest.mark.parametrize("known", [0, 40, 5_000])
def test_ids_are_the_librarys(spark, codec, known):
    """Whatever words are looked up, and with words of many chunks."""
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, codec, known), codec).select("row.doc_id", "ids", "decoded").collect()}
    for doc_id, text in rows:
        assert got[doc_id] == (LIBRARY.encode_ordinary(text or ""), (text or "").encode()), repr(text)[:80]


def test_every_piece_of_the_vocabulary_is_one_token(spark, codec):
    """In one word the leftmost pair of the lowest rank is merged first, which meets every piece."""
    pieces = [(r, p.decode("latin-1")) for p, r in RANKS.items()]
    df = spark.createDataFrame(pieces, "id int, piece string").repartition(4)
    start = lambda t: F.aggregate(F.sequence(F.lit(2), F.greatest(F.length("piece"), F.lit(2))), byte_bpe._start(t, F.col("piece")), lambda s, _: F.when(F.size(s) > 1, byte_bpe._merge(t, s)).otherwise(s))
    bad = df.select("id", byte_bpe._let(codec.ranks, lambda t: F.transform(start(t), lambda x: x["id"])).alias("ids")).where("size(ids) <> 1 or ids[0] <> id")
    assert bad.count() == 0


def test_classes_are_the_librarys(spark, codec):
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    words = spark.range(1).select(codec.words(F.lit(every)).alias("w")).first().w
    assert "".join(words) == every
    split = tiktoken.Encoding("split", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert [i for w in words[:2000] for i in split.encode_ordinary(w)] == split.encode_ordinary("".join(words[:2000]))
    import regex

    assert all(regex.fullmatch(public_tokenizers.PATTERN, w) or any(ord(c) > 0x300 for c in w) for w in words)


def test_awkward_documents(spark, codec):
    rows = documents()
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(frame(spark, rows), codec), codec), codec).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = [digest(r[0], r[1]) for r in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(frame(spark, rows).where("false"), codec).count() == 0


def test_unknown_ids_decode_to_null(spark, codec):
    df = spark.createDataFrame([([1, 2, 99_999],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in byte_bpe.decode(df, codec).select("decoded").collect()] == [None, b"", None]


def digest(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_is_the_library_on_every_document(spark):
    sf = "/root/testdata/sf0.01"
    got = {tuple(r) for r in queries.op12_byte_bpe(spark, sf).collect()}
    assert got == {digest(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()}


def test_no_text_is_shuffled(spark, codec):
    """Texts are encoded and decoded by projections of the scan, without Python."""
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    plan = byte_bpe.decode(byte_bpe.encode(docs, codec, 10), codec)._jdf.queryExecution().executedPlan()
    nodes, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        nodes.append(node.nodeName())
        waiting += [node.children().apply(i) for i in range(node.children().length())]
    assert any("Scan" in n for n in nodes) and all(n.startswith(("Project", "Scan", "WholeStageCodegen", "InputAdapter", "ColumnarToRow", "FileScan")) for n in nodes), nodes


def test_short_words_by_rank(spark, codec):
    """Merges in the order of rank and place give the library's ids, for random bytes of up to SHORT and beyond; a piece with falling ranks is noticed."""
    rng = random.Random(2)
    syllables = ["th", "er", "on", "a", "e", "i", "ñ", "ß", "ing", "ción", "x", "--", "aa", "0", "漢"]
    words = {"".join(rng.choice(syllables) for _ in range(rng.randint(1, 14))) for _ in range(4_000)} | {"a" * i for i in range(1, 60)}
    docs = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    ids = lambda t: F.struct(byte_bpe.fold(t, F.col("word"), True).alias("swept"), byte_bpe.fold(t, F.col("word")).alias("stepped"))
    assert byte_bpe.ranks_rise(RANKS) and codec.rising
    for r in docs.select("word", byte_bpe._let(codec.ranks, ids).alias("ids")).collect():
        assert r.ids.swept == r.ids.stepped == LIBRARY._core_bpe.encode_single_piece(r.word.encode()), r.word
    alone = {bytes([b]): b for b in range(256)}
    assert not byte_bpe.ranks_rise(alone | {b"bc": 301, b"abc": 300})
    assert byte_bpe.ranks_rise(alone | {b"bc": 300, b"abc": 301})


def test_hash_is_sparks(spark):
    texts = ["", "a", "ab", "abc", "abcd", "é", "aé漢\U0001f600", "x" * 31]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.hash("t").alias("h"))
    assert all(byte_bpe.murmur3(r.t.encode()) == r.h % 2**32 for r in df.collect())
