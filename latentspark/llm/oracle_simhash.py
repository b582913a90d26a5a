"""DuckDB SQL of the SimHash query, XXH64 included: 128-bit integers hold the products of 64-bit ones."""

from __future__ import annotations

# The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
LOW = f"{2**64 - 1}::UHUGEINT"
P = [f"{p}::UHUGEINT" for p in PRIMES]


def _rotated(x: str, by: int) -> str:
    return f"(((({x}) * {1 << by}::UHUGEINT) & {LOW}) + (({x}) >> {64 - by}::UHUGEINT))"


def _times(x: str, p: str) -> str:
    return f"((({x}) * {p}) & {LOW})"


def _round(a: str, word: str) -> str:
    return _times(_rotated(f"({a} + {word} * {P[1]}) & {LOW}", 31), P[0])


def _word(at: str, size: int = 8) -> str:
    """Little-endian number of ``size`` bytes from the hexadecimal text h."""
    pairs = " || ".join(f"substr(h, CAST({at} AS BIGINT) * 2 + {2 * i + 1}, 2)" for i in reversed(range(size)))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def _folded(first: str, count: str, word: str, step: str) -> str:
    """A value carried over ``count`` words; step says how, of a and w."""
    return f"list_reduce(list_prepend({first}, list_transform(range(0, {count}), lambda k: {word})), lambda a, w: {step})"


def xxh64(table: str, prefix: str) -> str:
    """Common table expressions that give ``{prefix}(s, x)``: the hash of each text s of a table, unsigned."""
    lanes = [(SEED + PRIMES[0] + PRIMES[1]) % 2**64, (SEED + PRIMES[1]) % 2**64, SEED, (SEED - PRIMES[0]) % 2**64]
    lane = [_folded(f"{v}::UHUGEINT", "n // 32", _word(f"(k * 32 + {8 * j})"), _round("a", "w")) for j, v in enumerate(lanes)]
    mixed = " + ".join(_rotated(f"v{j + 1}", by) for j, by in enumerate((1, 7, 12, 18)))
    merged = f"list_reduce([({mixed}) & {LOW}, v1, v2, v3, v4], lambda a, w: (xor(a, {_round('0::UHUGEINT', 'w')}) * {P[0]} + {P[3]}) & {LOW})"
    eights = f"({_rotated(f'xor(a, {_round("0::UHUGEINT", "w")})', 27)} * {P[0]} + {P[3]}) & {LOW}"
    fours = f"({_rotated(f'xor(x, {_times(_word("(n // 8 * 8)", 4), P[0])})', 23)} * {P[1]} + {P[2]}) & {LOW}"
    ones = _times(_rotated(f"xor(a, {_times('w', P[4])})", 11), P[0])
    return f"""{prefix}0 AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM {table}),
{prefix}1 AS (SELECT *, {lane[0]} AS v1, {lane[1]} AS v2, {lane[2]} AS v3, {lane[3]} AS v4 FROM {prefix}0),
{prefix}2 AS (SELECT s, h, n, CASE WHEN n >= 32 THEN {merged} ELSE ({SEED}::UHUGEINT + {P[4]}) & {LOW} END AS x FROM {prefix}1),
{prefix}3 AS (SELECT s, h, n, {_folded(f"(x + n::UHUGEINT) & {LOW}", "n % 32 // 8", _word("(n // 32 * 32 + k * 8)"), eights)} AS x FROM {prefix}2),
{prefix}4 AS (SELECT s, h, n, CASE WHEN n % 8 >= 4 THEN {fours} ELSE x END AS x FROM {prefix}3),
{prefix}5 AS (SELECT s, {_folded("x", "n % 4", _word("(n // 4 * 4 + k)", 1), ones)} AS x FROM {prefix}4),
{prefix}6 AS (SELECT s, {_times("xor(x, x >> 33::UHUGEINT)", P[1])} AS x FROM {prefix}5),
{prefix}7 AS (SELECT s, {_times("xor(x, x >> 29::UHUGEINT)", P[2])} AS x FROM {prefix}6),
{prefix} AS (SELECT s, CAST(xor(x, x >> 32::UHUGEINT) AS UBIGINT) AS x FROM {prefix}7)"""


_SUMS = ", ".join(f"sum(c * CAST((x >> {b}::UBIGINT) & 1::UBIGINT AS BIGINT)) AS b{b}" for b in range(64))
_BITS = " + ".join(f"CASE WHEN 2 * b{b} > total THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))

OP5 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)) GROUP BY doc_id, s
), strings AS (SELECT DISTINCT s FROM shingles), {xxh64("strings", "hashed")},
sums AS (SELECT doc_id, sum(c) AS total, {_SUMS} FROM shingles JOIN hashed ON shingles.s = hashed.s GROUP BY doc_id),
prints AS (SELECT d.doc_id, coalesce(CAST({_BITS} AS UBIGINT), 0::UBIGINT) AS fp FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id),
groups AS (SELECT fp, min(doc_id) AS least_id FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM groups a JOIN groups b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, b FROM r),
components AS (SELECT g.fp, least(g.least_id, coalesce(min(h.least_id), g.least_id)) AS component_id FROM groups g LEFT JOIN reach ON g.fp = reach.a LEFT JOIN groups h ON reach.b = h.fp GROUP BY g.fp, g.least_id)
SELECT p.doc_id, lower(lpad(to_hex(p.fp), 16, '0')) AS fingerprint, c.component_id FROM prints p JOIN components c ON p.fp = c.fp
"""
