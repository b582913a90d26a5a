"""Language identification by rank-order n-gram profiles and out-of-place distance.

A text is lower-cased; each run of anything but letters and marks becomes one
space. Its ``PROFILE`` most frequent 1- to 3-grams are ranked (ties by code
point) and compared to each language's profile: an n-gram costs the difference
of its ranks, or ``PROFILE`` where the profile lacks it. Ranking takes place per
text in numpy; no row is sent anywhere.

Profiles are learned from at most ``MAX_TRAIN`` documents of each language, chosen
by a hash of doc_id over the whole table, outside the held-out fold and with a lang.

Defined cases: a null or letterless text (marks and digits alone too) is ``und`` with score 0; with no learned
language every text is ``und``; equal distances take the first language by code
point; repeated rows get equal results; an empty table gives an empty result;
other columns are kept by ``keep_identified`` and else unread.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, cut_lineage, held_out, in_one_column

PROFILE = 400
ORDERS = (1, 2, 3)
#: Documents that a language's profile is learned from.
MAX_TRAIN = 1500
#: Leading digits of a hash that are counted.
DIGITS = 3
#: Languages of which a row each may be broadcast.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
#: Rows of a batch of counted n-grams.
GRAM_ROWS = 100_000
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, itself if it is a letter, its negative if a mark, else a space."""
    table = np.full(sys.maxunicode + 1, SPACE, np.int64)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            table[c] = c if kind == "L" else -c
    return table


def normal_codes(text: str | None) -> np.ndarray:
    """Code points of the letters and marks of a text, words parted and enclosed by one space; empty if it has no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[raw]
    if not (codes > SPACE).any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[SPACE], np.abs(codes), [SPACE]])
    space = codes == SPACE
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) and counts of the 1- to 3-grams but the lone space, ordered by code."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet, place = np.unique(codes, return_inverse=True)
    k, grams, counts = len(alphabet), [], []
    index = place
    for order in ORDERS:
        if order > 1:
            index = index[:-1] * k + place[order - 1 :]
        if k**order <= max(1 << 16, 4 * len(codes)):
            n = np.bincount(index, minlength=1)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(index, return_counts=True)
        code, rest = np.zeros(len(found), np.int64), found
        for at in range(order):
            code |= alphabet[rest % k] << (21 * at)
            rest = rest // k
        grams.append(code)
        counts.append(n)
    code, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    return code[code != SPACE], n[code != SPACE]


def ranked(codes: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    """The most frequent n-grams, first to last; of equal counts the lower code comes first."""
    if len(codes) > profile:
        least = np.partition(counts, len(counts) - profile)[len(counts) - profile]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")][:profile]


class Profiles:
    """Ranks of each known n-gram in each language's profile."""

    def __init__(self, by_language: dict[str, np.ndarray], profile: int = PROFILE) -> None:
        self.profile = profile
        self.languages = sorted(by_language)
        self.codes = np.unique(np.concatenate([by_language[x] for x in self.languages])) if self.languages else np.zeros(0, np.int64)
        # The last row is for n-grams that no profile has.
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), profile, np.int64)
        self.missing = len(self.codes)
        for j, x in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, by_language[x]), j] = np.arange(len(by_language[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = normal_codes(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        grams = ranked(*gram_counts(codes), self.profile)
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == grams, at, self.missing)]
        apart = np.abs(ranks - np.arange(len(grams))[:, None])
        apart[ranks == self.profile] = self.profile
        distance = apart.sum(axis=0) / (self.profile * len(grams))
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = totals.setdefault(lang, {})
            for code, n in zip(*(x.tolist() for x in gram_counts(normal_codes(text))), strict=True):
                own[code] = own.get(code, 0) + n
    for lang, own in totals.items():
        grams, n = pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())
        for k in range(0, len(own), GRAM_ROWS):
            part = grams[k : k + GRAM_ROWS]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "gram": part, "n": n[k : k + GRAM_ROWS]})


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` of each language by hash; rows of one id at the end of that order all count.

    Hashes are counted by their first digits, which shows the digits that the last wanted hash begins with; only rows of
    those are ordered. What the rows are then joined with is one hash a language.
    """
    order = F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    rows = rows.where(F.col("doc_id").isNotNull()).withColumn("h", order)
    narrow = rows.select(F.col("lang").alias("of"), "h", F.substring("h", 1, DIGITS).alias("head"))
    counts = narrow.groupBy("of", "head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.withColumn("before", before).where(F.col("before") < most).groupBy("of").agg(F.max(F.struct("head", "before", "n")).alias("last"))
    heads = cut_lineage(heads.select("of", "last.*"))
    small = heads.count() <= BROADCAST_LANGUAGES

    def joined(left: DataFrame, right: DataFrame, on) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on)

    last = joined(narrow.withColumnRenamed("head", "own"), heads.withColumnRenamed("of", "its"), (F.col("of") == F.col("its")) & (F.col("own") == F.col("head")))
    place = F.row_number().over(Window.partitionBy("of").orderBy("h"))
    wanted = F.least(F.lit(most) - F.col("before"), F.col("n"))
    ends = last.withColumn("place", place).where(F.col("place") == wanted).select(F.col("of"), F.col("h").alias("end"))
    return joined(rows, ends, F.col("lang") == F.col("of")).where(F.col("h") <= F.col("end"))


def learn_profiles(docs: DataFrame, max_train: int = MAX_TRAIN, profile: int = PROFILE) -> Profiles:
    """Profiles of the languages in the bounded samples; at most profile rows a language reach the driver."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = _sample(rows, max_train).select("lang", "text")
    grams = sample.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Counts of all n-grams may be millions, so they are cut before they are gathered.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = grams.withColumn("place", place).where(F.col("place") <= profile)
    ordered = F.array_sort(F.collect_list(F.struct("place", "gram")))
    top = first.groupBy("lang").agg(ordered.alias("top")).select("lang", F.col("top.gram").alias("grams")).collect()
    return Profiles({r.lang: np.array(r.grams, np.int64) for r in top if r.lang}, profile)


def _predict_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = shared.value
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, max_train: int = MAX_TRAIN, profile: int = PROFILE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_profiles(docs, max_train, profile))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_predict_batches(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, max_train: int = MAX_TRAIN, profile: int = PROFILE) -> DataFrame:
    """The rows of docs with a language, lang being the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_profiles(docs, max_train, profile))
    rows = docs.select(in_one_column(docs), F.col("text").cast("string"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    found = rows.mapInArrow(_predict_batches(shared), schema).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*((F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns))
