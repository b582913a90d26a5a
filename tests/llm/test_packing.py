import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latentspark.llm import packing
from tests.llm.fixtures import documents, frame


def check_sequences(pieces, capacity):
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return used


def test_pieces_and_sequences(spark):
    rows = documents()
    got = packing.pack(frame(spark, rows), with_ids=True).collect()
    plain = library()
    expected = []
    for r in rows:
        ids = [*plain(r[1] or ""), 0]
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            expected.append((str(r[0]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32, p.ids) for p in got) == sorted(expected)
    used = check_sequences(got, 2048)
    assert len(used) <= -(-sum(p.length for p in got) // 2048) + 1


@pytest.mark.parametrize("capacity,shard", [(64, 20), (2048, 7)])
def test_small_capacity_and_shards(spark, capacity, shard):
    got = packing.pack(frame(spark, documents()), capacity=capacity, shard_pieces=shard).collect()
    check_sequences(got, capacity)
    assert all(p.length <= capacity for p in got)


@given(st.integers(1, 40), st.data())
@settings(max_examples=60, deadline=None)
def test_each_piece_goes_to_the_least_sum_of_squares(capacity, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=60)), np.int64)
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for k in np.argsort(-lengths, kind="stable"):
        size, choices = int(lengths[k]), {}
        for at, gap in gaps.items():
            if gap >= size:
                after = {**gaps, at: gap - size}
                n = np.bincount([g for g in after.values() if g], minlength=capacity + 1)
                choices[at] = int((n**2).sum())
        at = int(sequence[k])
        assert (choices[at] == min(choices.values())) if choices else at not in gaps
        assert offset[k] == capacity - gaps.get(at, capacity)
        gaps[at] = gaps.get(at, capacity) - size


def library():
    """Plain use of the library, as the vocabulary's description has it."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


AWKWARD = ["", " ", "  a  b\n\n c\t", "don't I'LL 's 'S 12345", "é́ ✓ 漢字かな 𝔘 \u200b\x00", "aaaaaaa" * 50, "##$$!!  ??", "a <|endoftext|> b", "<|endoftext|>", "x \x1c y \x85 z \u180e w \u3000 v", "a\tb \t c \t", "a\r b \r c"]


def encode(texts, part_chars=packing.PART_CHARS):
    return [x.tolist() for x in packing.encoder(packing.default_vocabulary()).ids(texts, part_chars)]


def test_ids_are_those_of_the_library():
    texts, plain = [r[1] or "" for r in documents()] + AWKWARD, library()
    expected = [plain(t) for t in texts]
    assert encode(texts) == expected
    assert encode(texts, 3) == expected
    assert encode([]) == []


def test_ids_of_a_whole_table(sf_dir="/root/testdata/sf0.01"):
    texts = [x or "" for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    plain = library()
    assert encode(texts, 1000) == [plain(t) for t in texts]


@given(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x85\xa0\u180e\u2003\u200b\u3000", "a", "I'll", "7", "é", "漢", ".", "<|endoftext|>", "\x00"]), max_size=12))
@settings(max_examples=400, deadline=None)
def test_parts_of_any_mixture(parts):
    text = "".join(parts)
    assert "".join(packing.parts_of(text, 1)) == text
    assert encode([text], 1) == [library_once(text)]


library_once = library()


@pytest.mark.parametrize("text", [" ", "\n", "\t", "a", "a ", "\u3000", "ab\n"])
def test_ids_of_a_million_characters(text):
    long = text * (1_000_000 // len(text))
    for whole in (long, long + "word", "a b" + long + "\n!d"):
        assert encode([whole]) == [library_once(whole)]


def test_few_kept_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 16)
    monkeypatch.setattr(packing, "WORDS", 3)
    monkeypatch.setattr(packing, "WORD_CHARS", 5)
    monkeypatch.setattr(packing, "BATCH_CHARS", 300)
    texts, plain = [r[1] or "" for r in documents()] + AWKWARD, library()
    encoder = packing.Encoder(packing.default_vocabulary())
    assert [x.tolist() for x in encoder.ids(texts, 40)] == [plain(t) for t in texts]


@given(st.lists(st.lists(st.sampled_from(["a", "b.", "Word!", "end?\nNext:", "it's", "don't", "I'll", "'s", "\n", "\n", "7é", "漢字", "<|endoftext|>", "\tx", "x" * 70, "word\nNext", "''ll"]), min_size=1, max_size=6), max_size=5))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_text(texts):
    joined = [" ".join(t) for t in texts] + ["\n".join(t) for t in texts] + ["".join(t) for t in texts]
    assert encode(joined) == [library_once(t) for t in joined]
    assert encode(joined, 4) == [library_once(t) for t in joined]


def test_empty_table(spark):
    assert packing.pack(frame(spark, documents()).where("false")).count() == 0
