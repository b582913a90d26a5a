r"""Byte-level BPE encoding and decoding with Spark's higher-order functions alone.

A text is split by the vocabulary's pattern in the JVM. A word's bytes are a list
of pieces; ``aggregate`` folds the merges over it, each step joining the leftmost
pair of the lowest rank, with the ranks in a literal map (two arrays in which a piece stands
at one of two places by its hash, since a lookup in one of Spark's maps is a scan).
Pieces are texts in which a character stands for a byte.

Where the ranks of merges only rise, as the driver finds of a vocabulary's pieces, the
merges of a short word come in the order of its parts by rank and place: each part
that is two tokens when its turn comes is merged, on borders that are bits of a number.

Words repeat, so the fold is over distinct words: those of a corpus are counted,
and the ids of the most frequent (``known_words`` of at most ``KNOWN_CHARS``
characters, which bounds the literal that tasks receive) are folded once, in
Spark, and looked up. A word beyond them is folded where it stands, so the size
of that list changes the time and nothing else. No row of a text or a word is
shuffled but the partial counts.

The fold takes the square of a word's length, so a word of more than ``CHUNK``
bytes is folded in chunks, which are stitched by pairs, like a tree. A list of tokens
is the encoding of its bytes when each two neighbours are the encoding of theirs:
where the last token of one part and the first of the next aren't, a window of
1, 2, 4 ... tokens of both is folded again until its ends agree with what is beside it.

Java's letters, numbers and blanks are those of its own version of Unicode, so the
pattern's classes are completed by the characters that the tiktoken library matches.

Decoding looks up the bytes of each id, as hexadecimal digits, and joins them.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts and
words may have any length; an id outside the vocabulary decodes to null; rows that
repeat are encoded each; an empty table gives an empty result; other columns are kept
in ``encode`` and not read.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm.common import in_one_column

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose ids are looked up, and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 200_000, 32
#: Bytes that are folded at once.
CHUNK = 48
#: Bytes of a word whose merges are found by rank, not step by step.
SHORT = 24
#: Places of the literal of ranks, and strings of that of words, by hash; powers of two.
RANK_PLACES, WORD_LISTS = 262_144, 65_536
#: Bits of the hash that the second place passes over.
PLACE_SHIFT = 14
#: What stands before and behind a word in those strings, and so in no word that they hold.
BEFORE, BEHIND = "\x01", "\x02"
#: No rank: above every id.
NONE = 2**31 - 1
#: A length that takes all that follows: more than any list of tokens holds.
REST = 2**30


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's pieces and ranks, read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _literal(value: object, kind: str) -> Column:
    """A nested value as one literal: the optimizer folds the parsed text once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def murmur3(data: bytes) -> int:
    """Spark's ``hash`` of a string, unsigned: its last bytes are mixed one by one."""
    h, whole = 42, len(data) // 4 * 4
    for k in (*(int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)), *((b - 256 if b > 127 else b) for b in data[whole:])):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _places(piece: str, n: int) -> tuple[int, int]:
    """The two places, of n, where a piece may stand."""
    code = murmur3(piece.encode())
    return code % n, (code >> PLACE_SHIFT) % n


def _placed(ranks: dict[str, int], n: int) -> tuple[list[str | None], list[int | None]]:
    """Pieces and their ranks, each at one of its two places: who comes to a taken one sends the other on to its second."""
    pieces: list[str | None] = [None] * n
    places = {piece: _places(piece, n) for piece in ranks}
    for piece in ranks:
        at = places[piece][0]
        for _ in range(100):
            piece, pieces[at] = pieces[at], piece
            if piece is None:
                break
            first, second = places[piece]
            at = second if at == first else first
        else:
            raise ValueError(f"{len(ranks)} pieces don't fit into {n} places")
    return pieces, [None if p is None else ranks[p] for p in pieces]


def _hashed(key: Column, n: int) -> Column:
    """Hash of a key modulo n, a power of two."""
    return F.hash(key).bitwiseAND(n - 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


@functools.cache
def _matched(pattern: str) -> frozenset[str]:
    """The characters that a class matches in tiktoken's expressions."""
    import tiktoken

    codes = (*range(0xD800), *range(0xE000, 0x110000))
    alone = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    few = (codes[i : i + 65_536] for i in range(0, len(codes), 65_536))
    return frozenset(c for some in few for c in bytes(alone.encode_ordinary("".join(map(chr, some)))).decode())


def _ranges(chars: Iterable[str]) -> str:
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""pattern with each of ``\s \S \p{L} \p{N}`` as what tiktoken takes it for, whatever the JVM's version of Unicode.

    The JVM asks a class's parts from left to right, so ASCII stands first and the characters it doesn't know are one part, the last.
    """
    codes = (*range(0xD800), *range(0xE000, 0x110000))
    classes = (r"\s", r"\p{L}", r"\p{N}")
    every = spark.createDataFrame([("".join(map(chr, codes[i : i + 4096])),) for i in range(0, len(codes), 4096)], "chars string").coalesce(1)
    parts = every.select(*(F.regexp_replace("chars", f"[^{c}]+", "").alias(f"c{i}") for i, c in enumerate(classes))).collect()
    here = ["".join(r[i] for r in parts) for i in range(len(classes))]
    whole = {}
    for c, found in zip(classes, here, strict=True):
        if set(found) - _matched(c):
            raise ValueError(f"the JVM's {c} holds characters that tiktoken's doesn't")
        more = _ranges(_matched(c) - set(found))
        ascii_first = _ranges(x for x in _matched(c) if x < "\x80")
        whole[c] = f"[{ascii_first}[{c}[{more}]]]" if more else f"[{ascii_first}{c}]"
    out, at, inside = "", 0, False
    while at < len(pattern):
        name = next((c for c in (*classes, r"\S") if pattern.startswith(c, at)), pattern[at])
        if name == r"\S":
            out += f"[^{whole[chr(92) + 's']}]"
        elif name in whole:
            out += whole[name] if inside else f"[{whole[name]}]"
        else:
            inside = name == "[" or inside and name != "]"
            out += name
        at += len(name)
    return out


def _between(i: int, size: int) -> tuple[int, int]:
    """The borders inside the size bytes from the i-th on (from 1), and those at their ends, as bits; none beyond ``SHORT``."""
    if not 1 <= i <= i + size - 1 <= SHORT or size < 2:
        return 0, 0
    first, last = 1 << i - 1, 1 << i - 1 + size
    return last - 2 * first, first | last


class Codec:
    """Column expressions that encode and decode by one vocabulary.

    The tables are literals. ``_let`` binds each once to a name that all of an
    expression refers to, for a task receives every literal that an expression holds.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = java_pattern(spark, pattern)
        pieces = {r: p.hex() for p, r in ranks.items()}
        every = range(max(pieces) + 1)
        placed, at = _placed({p.decode("latin-1"): r for p, r in ranks.items()}, RANK_PLACES)
        self.ranks = _literal(
            {
                "pieces": placed,
                "ranks": at,
                "bytes": [ranks[bytes([b])] for b in range(256)],
                "inside": [_between(i, size)[0] for i in range(32) for size in range(32)],
                "ends": [_between(i, size)[1] for i in range(32) for size in range(32)],
            },
            "struct<pieces:array<string>,ranks:array<int>,bytes:array<int>,inside:array<int>,ends:array<int>>",
        )
        self.rising = ranks_rise(ranks)
        self.pieces = _literal([pieces.get(r) for r in every], "array<string>")
        self.little = _literal([r.to_bytes(4, "little").hex() for r in every], "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    def known(self, texts: DataFrame, n: int = KNOWN_WORDS) -> Column:
        """A literal of the ids of the n most frequent words of a column ``text``: strings of words and their ids, by hash."""
        words = texts.select(F.explode(self.words(F.col("text"))).alias("word")).where(F.length("word") <= KNOWN_CHARS)
        frequent = words.groupBy("word").count().where(~F.col("word").rlike(f"[{BEFORE}{BEHIND}]")).orderBy(F.desc("count"), "word").limit(n).select("word")
        parallel = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = _let(self.ranks, lambda t: fold(t, F.col("word"), self.rising))
        found = frequent.repartition(parallel, "word").select("word", F.array_join(ids, ",").alias("ids"), _hashed(F.col("word"), WORD_LISTS).alias("at")).toPandas()
        lists = [BEFORE] * WORD_LISTS
        for word, listed, at in zip(found["word"], found["ids"], found["at"], strict=True):
            lists[at] += f"{word}{BEHIND}{listed}{BEFORE}"
        return _literal(lists, "array<string>")

    def encode(self, text: Column, known: Column) -> Column:
        """Ids of a text."""

        def listed(tables: Column) -> Column:
            ranks, known = tables["ranks"], tables["known"]

            def ids(word: Column) -> Column:
                behind = F.call_function("substring_index", known[_hashed(word, WORD_LISTS)], F.concat(F.lit(BEFORE), word, F.lit(BEHIND)), F.lit(-1))
                # Without the word, the whole list is left, which begins with its mark.
                return F.when(F.startswith(behind, F.lit(BEFORE)), F.array_join(fold(ranks, word, self.rising), ",")).otherwise(F.substring_index(behind, BEFORE, 1))

            return F.array_join(F.transform(self.words(text), ids), ",")

        joined = _let(F.struct(self.ranks.alias("ranks"), known.alias("known")), listed)
        return _let(joined, lambda all_ids: F.when(all_ids != "", F.split(all_ids, ",").cast("array<int>")).otherwise(F.array().cast("array<int>")))

    def decode(self, ids: Column) -> Column:
        """Bytes of a list of ids; null if any is unknown, as its digits are none."""
        return F.unhex(F.array_join(_let(self.pieces, lambda pieces: F.transform(ids, lambda i: F.get(pieces, i))), "", "?"))

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian words of 32 bits."""
        return F.unhex(F.array_join(_let(self.little, lambda words: F.transform(ids, lambda i: words[i])), ""))


def _rank_of(tables: Column, piece: Column) -> Column:
    """Rank of a piece, null without one."""

    def at(place: Column) -> tuple[Column, Column]:
        return tables["pieces"][place] == piece, tables["ranks"][place]

    code = F.hash(piece)
    return F.when(*at(code.bitwiseAND(RANK_PLACES - 1))).when(*at(F.shiftright(code, PLACE_SHIFT).bitwiseAND(RANK_PLACES - 1)))


def _rank(tables: Column, piece: Column) -> Column:
    return F.coalesce(_rank_of(tables, piece), F.lit(NONE))


def _token(rank: Column, start: Column, part: Column, token_id: Column) -> Column:
    """A piece: the rank of its merge with the next one, where it starts, its bytes and its id. Ordered by rank, then place."""
    return F.struct(rank.alias("rank"), start.alias("start"), part.alias("part"), token_id.alias("id"))


def _start(tables: Column, piece: Column) -> Column:
    """The tokens before the first merge: every byte a token; the whole piece where it has a rank."""
    one_by_one = _let(F.split(piece, ""), lambda parts: F.transform(
        parts,
        lambda b, i: _token(F.when(i + 1 < F.size(parts), _rank(tables, F.concat(b, F.get(parts, i + 1)))).otherwise(NONE), i, b, tables["bytes"][F.ascii(b)]),
    ))
    return _let(_rank(tables, piece), lambda whole: F.when(whole < NONE, F.array(_token(F.lit(NONE), F.lit(0), piece, whole))).otherwise(one_by_one))


def _merge(tables: Column, tokens: Column) -> Column:
    """One merge: the leftmost pair of the lowest rank, and the ranks of the new token and of the one before it."""

    def merged(low: Column) -> Column:
        def at(p: Column) -> Column:
            def joined(part: Column) -> Column:
                after, before = F.get(tokens, p + 1), F.get(tokens, p - 2)
                new = F.array(_token(F.when(p + 1 < F.size(tokens), _rank(tables, F.concat(part, after["part"]))).otherwise(NONE), low["start"], part, low["rank"]))
                ahead = F.array(_token(_rank(tables, F.concat(before["part"], part)), before["start"], before["part"], before["id"]))
                rest = F.slice(tokens, p + 2, REST)
                return F.when(p > 1, F.concat(F.slice(tokens, 1, p - 2), ahead, new, rest)).otherwise(F.concat(new, rest))

            return _let(F.concat(low["part"], tokens[p]["part"]), joined)

        return F.when(low["rank"] < NONE, _let(F.array_position(tokens, low).cast("int"), at)).otherwise(tokens)

    return _let(F.array_min(tokens), merged)


def _fold(tables: Column, piece: Column) -> Column:
    """Tokens of a piece, a character for each byte."""
    steps = F.sequence(F.lit(2), F.greatest(F.length(piece), F.lit(2)))
    # Two tokens or more are left to merge, or the fold is over.
    return F.aggregate(steps, _start(tables, piece), lambda tokens, _: F.when(F.size(tokens) > 1, _merge(tables, tokens)).otherwise(tokens))


def _parts(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["part"])


def _stitch(tables: Column, a: Column, b: Column) -> Column:
    """Tokens of two parts that follow each other."""
    none = F.slice(a, 1, 0)

    def attempt(k: Column) -> Column:
        near = F.concat(F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, k), F.slice(b, 1, k))
        before, after = F.slice(a, 1, F.greatest(F.size(a) - k, F.lit(0))), F.slice(b, k + 1, REST)

        def judged(window: Column) -> Column:
            line = F.concat(F.slice(before, F.greatest(F.size(before), F.lit(1)), 1), window, F.slice(after, 1, 1))
            n = F.size(line)
            # The ends of the window with what is beside it; without a window the ends of both parts.
            sides = F.when(k > 0, F.concat(
                F.slice(F.array(F.slice(line, 1, 2)), 1, F.least(F.size(before), F.lit(1))),
                F.slice(F.array(F.slice(line, F.greatest(n - 1, F.lit(1)), 2)), 1, F.least(F.size(after), F.lit(1))),
            )).otherwise(F.array(line))
            holds = F.forall(F.transform(sides, _parts), lambda pair: _parts(_fold(tables, F.array_join(pair, ""))) == pair)
            return F.struct(holds.alias("done"), F.concat(before, window, after).alias("tokens"))

        return _let(F.when(k > 0, _fold(tables, F.array_join(_parts(near), ""))).otherwise(none), judged)

    most = F.greatest(F.size(a), F.size(b))
    widths = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), F.ceil(F.log2(most)).cast("int")), lambda e: F.pow(F.lit(2), e).cast("int")))
    start = F.struct(F.lit(False).alias("done"), none.alias("tokens"))
    return F.aggregate(widths, start, lambda s, k: F.when(s["done"], s).otherwise(attempt(k)), lambda s: s["tokens"])


def ranks_rise(ranks: dict[bytes, int]) -> bool:
    """Whether the merges that lead to any piece of at most ``SHORT`` bytes rise in rank.

    Two tokens that meet in a word were made from their bytes alone, so these are all
    the merges there are: where they rise, no merge makes way for one of a lower rank.
    """
    for piece in ranks:
        parts, last = [piece[i : i + 1] for i in range(len(piece))] if len(piece) <= SHORT else [], -1
        while len(parts) > 1:
            low, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low < last:
                return False
            if low == NONE:
                break
            parts[at : at + 2], last = [parts[at] + parts[at + 1]], low
    return True


def _bits(name: str, a: Column, b: Column | int) -> Column:
    return F.call_function(name, a, b if isinstance(b, Column) else F.lit(b))


def _swept(tables: Column, piece: Column) -> Column:
    """Ids of a piece of at most ``SHORT`` bytes, where ranks rise: its parts that have a rank, by rank and place, are merged if they are two tokens then.

    The borders of tokens are the bits of a number, one for each byte and one for the end.
    """
    n = F.length(piece)

    def ranked(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), n - i + 1), lambda size: _rank_of(tables, F.substring(piece, i, size)) * 1024 + (i * 32 + size))

    def merged(borders: Column, code: Column) -> Column:
        at = code.bitwiseAND(1023)
        inside, ends = tables["inside"][at], tables["ends"][at]
        whole = F.bit_count(borders.bitwiseAND(inside)) == 1
        return F.when(whole & (borders.bitwiseAND(ends) == ends), borders.bitwiseAND(F.bitwise_not(inside))).otherwise(borders)

    def ids(borders: Column) -> Column:
        def token(i: Column) -> Column:
            return _let(_bits("shiftright", borders, i), lambda rest: _rank_of(tables, F.substring(piece, i, F.bit_count(rest.bitwiseAND(-rest) - 1) + 1)))

        return F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: _bits("shiftright", borders, i - 1).bitwiseAND(1) == 1), token)

    codes = F.sort_array(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), ranked))))
    return _let(F.aggregate(codes, _bits("shiftleft", F.lit(2), n) - 1, merged), ids)


def fold(tables: Column, word: Column, rising: bool = False) -> Column:
    """Ids of a word of any length, by the literal of ranks."""
    by_steps = _stepped(tables, word)
    if not rising:
        return by_steps
    swept = _let(F.decode(word.cast("binary"), "ISO-8859-1"), lambda piece: _let(_rank_of(tables, piece), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_swept(tables, piece))))
    return F.when(F.octet_length(word) <= SHORT, swept).otherwise(by_steps)


def _stepped(tables: Column, word: Column) -> Column:
    """Ids of a word, one merge after the other."""
    raw = word.cast("binary")
    chunk = lambda i: _fold(tables, F.decode(F.substring(raw, i * CHUNK + 1, F.lit(CHUNK)), "ISO-8859-1"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(word) - 1) / CHUNK).cast("int")), chunk)
    halves = F.sequence(F.lit(1), F.ceil(F.log2(F.octet_length(word) / CHUNK)).cast("int"))
    paired = lambda cs: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(cs) - 1) / 2).cast("int")),
        lambda j: F.when(2 * j + 1 < F.size(cs), _stitch(tables, cs[2 * j], F.get(cs, 2 * j + 1))).otherwise(cs[2 * j]),
    )
    tokens = F.when(F.octet_length(word) <= CHUNK, _fold(tables, F.decode(raw, "ISO-8859-1"))).otherwise(F.aggregate(halves, chunks, lambda cs, _: paired(cs))[0])
    return F.transform(tokens, lambda t: t["id"])


def public_codec(spark: SparkSession, vocabulary_path: str | None = None) -> Codec:
    """The codec of the public vocabulary, or of a rank file of the same pattern."""
    import public_tokenizers

    return Codec(spark, read_ranks(vocabulary_path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def encode(docs: DataFrame, codec: Codec, known_words: int = KNOWN_WORDS) -> DataFrame:
    """``(row, ids)``: all columns of docs as one struct, and the ids of its text."""
    known = codec.known(docs.select(F.col("text").cast("string").alias("text")), known_words)
    return docs.select(in_one_column(docs), codec.encode(F.col("text").cast("string"), known).alias("ids"))


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``encoded`` and ``decoded``, the bytes of its ids."""
    return encoded.select("*", codec.decode(F.col("ids")).alias("decoded"))


def digests(decoded: DataFrame, codec: Codec) -> DataFrame:
    """Digests of ids, as little-endian words of 32 bits, and of the decoded bytes."""
    return decoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(codec.packed(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
