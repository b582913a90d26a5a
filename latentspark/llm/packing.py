"""Sum-of-squares packing of tokenized documents into sequences of at most ``CAPACITY`` tokens.

A document is its token ids and a closing id 0. One longer than the capacity is
cut from its end into pieces of the capacity, so that only its first piece may be
shorter. Pieces are dealt evenly to shards of about ``SHARD_PIECES`` rows; in a
shard, longest first, each piece goes to the open sequence with which the sum over
residual gaps of the squared number of open sequences becomes smallest, and to a
new one where it fits none. Shards leave an open sequence or two each, which
bounds what is wasted.

Ids are those of ``tokenizers`` with the vocabulary file, used as the file's
description says: strings of special tokens in a text are ordinary text
(``encode_special_tokens``). The library holds about 100 bytes a token while it
works, so a long text is given to it in parts: a blank between two characters that
are not white space always begins a piece of the vocabulary's pattern, and parts
that begin there give the ids of the whole. Token ids stay in the worker unless
asked for, so that a shuffle carries about 40 bytes a piece.

Defined cases: a null or empty text is the single token 0; an empty table gives
an empty result; rows that repeat a document are packed each on its own; a piece
of exactly the capacity fills a sequence; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, cut_lineage

CAPACITY = 2048
SHARD_PIECES = 32_768
VOCABULARY = "byte_bpe_50k.json"
CLOSING = 0
#: Ranks a new sequence behind every open one that fits; no count comes near it.
NEW = -1e15
#: A text is cut at the first such blank after so many characters, and about so many are worked on at a time.
PART_CHARS, BATCH_CHARS = 1 << 18, 3 << 20
#: Words whose ids a worker keeps (some 30 MB), the longest of them, and those encoded in one call.
MEMO, WORD_CHARS, WORDS = 1 << 19, 64, 1 << 12
#: White space of any version of Unicode, and blanks and line ends beside it or at an end.
_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_WHITE = rf"\A[ \n]|[ \n]\z|[{_WHITE}][ \n]|[ \n][{_WHITE}]"
#: A word of ASCII letters behind a blank or line end, with or without a mark behind it: each of the three is a piece.
_MARKS = "\n.,;:!?"
_LETTERS = re.compile(r"(\n?)([A-Za-z]+)([.,;:!?]?)")
#: A blank whose neighbours are not white space in any version of Unicode.
_BLANK = re.compile(r"(?<![\s\u180e]) (?![\s\u180e])")
_encoders: dict[str, Encoder] = {}


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """A text cut where the ids of the parts are those of the whole."""
    at = 0
    while len(text) - at > size and (blank := _BLANK.search(text, at + size)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def _with_blank(word: str) -> str:
    return word if word[:1] == "\n" else f" {word}"


class Encoder:
    """Ids of texts by ``tokenizers``."""

    def __init__(self, vocabulary_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path)
        self.tokenizer.encode_special_tokens = True
        ((self.tab,),) = self._encode(["\t"])
        # What a piece is after splitting: its blank has a letter of its own.
        self.merges, self.blank = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        self.marks = dict(zip(_MARKS, map(np.ndarray.tolist, self._encode(list(_MARKS))), strict=True)) | {"": []}
        self._forget()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """The words kept, in Arrow's memory, the ids of all one after another, and where each word's end."""
        self.known, self.words = pa.array([], pa.large_string()), 0
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64)

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> None:
        used = int(self.ends[self.words])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(ends) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[self.words + 1 : self.words + 1 + len(ends)] = used + ends
        self.words += len(ends)

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of new words. They are encoded together, a tab behind each: before white space and a word a tab is a token of its own."""
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            (ids,) = self._encode(["\t".join(map(_with_blank, part)) + "\t"])
            tabs = np.flatnonzero(ids == self.tab)
            self._keep(np.delete(ids, tabs), tabs - np.arange(len(part)))

    def _learn_letters(self, words: list[str]) -> None:
        """The same of ``_LETTERS``, whose pieces are known: the library's merges without its splitting."""
        tokenize, ids = self.merges.tokenize, []
        for word in words:
            start, letters, mark = _LETTERS.fullmatch(word).groups()
            found = [t.id for t in tokenize(letters if start else self.blank + letters)]
            ids.append([*self.marks[start], *found, *self.marks[mark]])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self._keep(np.fromiter(itertools.chain.from_iterable(ids), np.uint32), ends)

    def _parts(self, parts: list[str], behind: list[bool]) -> Iterator[np.ndarray]:
        """The ids of parts; behind: a blank goes before the part."""
        if self.words > MEMO:
            self._forget()
        texts = pa.array(parts, pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD_WHITE).to_numpy(zero_copy_only=False)
        # "a b\nc" as "a", "b" and "\nc": a word begins with its line end, or follows a blank.
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        unseen = coded.dictionary.take(pa.array(new)).to_pylist()
        rare = np.array([len(w) > WORD_CHARS or "\t" in w for w in unseen], bool)
        letters = np.array([_LETTERS.fullmatch(w) is not None for w in unseen], bool) & ~rare
        for some, learn in ((np.flatnonzero(letters), self._learn_letters), (np.flatnonzero(~letters & ~rare), self._learn)):
            number[new[some]] = self.words + np.arange(len(some))
            learn([unseen[k] for k in some.tolist()])
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(pa.array(new[some]))])
        # Words that aren't kept, and first words that follow no blank, are encoded one by one.
        kept, bounds = self.words, lists.offsets.to_numpy().astype(np.int64)
        at_start = bounds[:-1][~np.array(behind, bool)[~odd]]
        number[new[rare]] = kept + np.arange(rare.sum())
        first = coded.dictionary.take(pa.array(index[at_start])).to_pylist()
        extra = self._encode([*(_with_blank(unseen[k]) for k in np.flatnonzero(rare).tolist()), *first])
        used, sizes = int(self.ends[kept]), np.array([len(x) for x in extra], np.int64)
        flat = np.concatenate([self.flat[:used], *extra])
        ends = np.concatenate([self.ends[: kept + 1], used + np.cumsum(sizes)])
        number = number[index]
        number[at_start] = kept + rare.sum() + np.arange(len(at_start))
        n = ends[number + 1] - ends[number]
        to = np.concatenate([[0], np.cumsum(n)])
        found = flat[np.repeat(ends[number] - to[:-1], n) + np.arange(to[-1])].astype("<u4")
        whole = (found[to[a] : to[b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        plain = iter(self._encode([" " * b + p for p, b, o in zip(parts, behind, odd, strict=True) if o]))
        return (next(plain) if o else next(whole) for o in odd.tolist())

    def ids(self, texts: Iterable[str], part_chars: int = PART_CHARS) -> Iterator[np.ndarray]:
        """The ids of each text."""
        waiting: list[tuple[str, bool, bool]] = []  # (part, a blank goes before it, it ends a text)
        ready: list[np.ndarray] = []
        chars = 0

        def flush() -> Iterator[np.ndarray]:
            for (_, _, last), ids in zip(waiting, self._parts([w[0] for w in waiting], [w[1] for w in waiting]), strict=True):
                ready.append(ids)
                if last:
                    yield ready[0] if len(ready) == 1 else np.concatenate(ready)
                    ready.clear()
            waiting.clear()

        for text in texts:
            cuts = list(parts_of(text, part_chars))
            for k, part in enumerate(cuts):
                waiting.append((part[1:] if k else part, k > 0, k == len(cuts) - 1))
                chars += len(part)
                if chars >= BATCH_CHARS:
                    yield from flush()
                    chars = 0
        if waiting:
            yield from flush()


def encoder(vocabulary_path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker."""
    if vocabulary_path not in _encoders:
        _encoders[vocabulary_path] = Encoder(vocabulary_path)
    return _encoders[vocabulary_path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for a shorter first one."""
    first = length % capacity
    bounds = ([0] if first else []) + list(range(first, length + 1, capacity))
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def _piece_batches(vocabulary_path: str | None, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary_path or default_vocabulary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            texts = (x or "" for x in batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoding.ids(texts), strict=True):
                ids = np.append(ids, np.array([CLOSING], "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, k, start, length, zlib.crc32(part.tobytes()), *([part] if with_ids else []))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names)

    return pieces


def tokenize_pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every piece of every row of docs."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_piece_batches(vocabulary_path, capacity, with_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length, placed longest first.

    With n(g) open sequences of gap g, putting a piece of size s into gap g changes
    half the sum of squares by n(g-s) - n(g) + 1, where a filled sequence no longer
    counts. The two ends of the arrays hold the constants that make a filled and a
    new sequence fit the same formula, the new one behind every open one.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -np.inf)
    count[0], taken[capacity] = -0.5, NEW
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        gap = size + int(np.argmin(count[: capacity - size + 1] - taken[size:]))
        if gap == capacity:
            at, used = used, used + 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
            taken[gap] = count[gap] or -np.inf
        sequence[k], offset[k] = at, capacity - gap
        if rest := gap - size:
            open_at[rest].append(at)
            count[rest] += 1
            taken[rest] = count[rest]
    return sequence, offset


def _pack_shard(capacity: int):
    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("__row", "ascending")])
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        shard = table.column("__shard").to_numpy()
        table = table.drop_columns(["__row", "__shard"])
        return table.append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column("offset", pa.array(offset))

    return pack_shard


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs with ``sequence_id`` and ``offset``."""
    pieces = cut_lineage(tokenize_pieces(docs, vocabulary_path, capacity, with_ids))
    shards = max(1, -(-pieces.count() // shard_pieces))
    # Row numbers are those of the materialised pieces, so a recomputed task deals them alike.
    dealt = pieces.withColumn("__row", F.monotonically_increasing_id()).withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)).cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return dealt.groupBy("__shard").applyInArrow(_pack_shard(capacity), schema)
