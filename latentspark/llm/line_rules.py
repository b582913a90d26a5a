"""Quality rules from cross-document line frequency, in DataFrame operations only.

Lines are normalised (trimmed, lower-cased, runs of white space and of digits
made one) and hashed. A line counts once for each distinct text of a host (its
``source``), so exact copies of one document count as one. A line found in more
than ``MIN_DOCS`` texts, and in more than ``MAX_SHARE`` of the host's or ``MAX_DOCS``
of them, is above the limit and is removed; a document that lines were removed from is depleted, and
rejected, when under ``MIN_LEFT`` of its words or under ``MIN_WORDS`` words stay.

Counts are sums combined on the map side; the frequent lines are joined back by
an equi-join whose hot keys adaptive execution may split.

Defined cases: a null or word-less text has no words and no lines and fails the
base rules; a null source is a host of its own; repeated rows get equal verdicts;
an empty table gives an empty result; a single line in one host is frequent only
by the same limits; other columns are kept by ``clean_rows`` and else unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import WHITE, cut_lineage, in_one_column, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 20
MAX_SHARE = 0.05
MAX_DOCS = 100
MIN_LEFT = 0.3
#: Removals up to this many texts and line keys (about 20 MB) are broadcast, more are joined by shuffling the texts.
BROADCAST_REMOVALS = 200_000


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _array_lag(values: Column, by: int) -> Column:
    """values without its first ``by`` elements."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _joined_hashes(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places on, as long as both exist."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), _array_lag(hashes, by), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorted (hash, place) pairs show the repeats."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

    def marked(placed: Column) -> Column:
        # Each pair beside its neighbours in hash order; the first and last lack one.
        sides = F.zip_with(F.concat(none, placed), F.concat(_array_lag(placed, 1), none), lambda x, z: F.struct(x.h.alias("x"), z.h.alias("z")))
        repeated = F.zip_with(placed, F.slice(sides, 1, F.size(placed)), lambda y, n: F.when(F.coalesce(y.h == n.x, F.lit(False)) | F.coalesce(y.h == n.z, F.lit(False)), y.i))
        return F.array_sort(F.filter(repeated, lambda i: i.isNotNull()))

    def length(places: Column) -> Column:
        steps = F.zip_with(places, _array_lag(places, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(placed, marked), length)


def _normal(text: Column) -> Column:
    """Lower case, runs of white space but line ends as one space, runs of digits as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), r"\d+", "0")


def _line_key(normal_line: Column) -> Column:
    return F.xxhash64(F.trim(normal_line))


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, WHITE, "")) > 0


def base_features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds to the named columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*(keep or ["doc_id"]), text.alias("__text"), F.transform(words_of(F.col("text").cast("string")), lambda w: F.xxhash64(w)).alias("__words"))
    # One projection for each doubling, so that none is computed more than once.
    for out, of, by in (("__two", "__words", 1), ("__four", "__two", 2), ("__windows", "__four", 4)):
        rows = rows.withColumn(out, _joined_hashes(F.col(of), by))
    lines = F.filter(F.split("__text", "\n"), _has_word)
    repeats = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), _covered(F.col("__windows"))).otherwise(0)
    # Always true, but not to the optimizer: it would else move a filter on the result below the
    # projections above and write their expressions out, each as often as it is used.
    repeats = F.when(F.spark_partition_id() >= 0, repeats).otherwise(0)
    rows = rows.select(
        "*", F.size("__words").cast("long").alias("n_words"), F.length(F.translate("__text", WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("__words", "__two", "__four", "__windows")


def _text_key(text: Column) -> Column:
    """128 bits of a text, as two longs in one string of fixed width."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(host, text_key, key, words)`` lines of each distinct text, and the ``(host, key, n_texts)`` above the limit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.filter(F.transform(F.split(_normal(text), "\n"), F.trim), lambda x: x != "")
    lines = F.transform(clean, lambda x: F.struct(_line_key(x).alias("key"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    narrow = docs.select(F.col("source").cast("string").alias("host"), _text_key(text).alias("text_key"), lines.alias("lines"))
    texts = cut_lineage(narrow.groupBy("host", "text_key").agg(F.first("lines").alias("lines")))
    flat = texts.select("host", "text_key", F.explode("lines").alias("line")).select("host", "text_key", "line.*")
    once = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key"))
    counts = once.groupBy("host", "key").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > min_docs)
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_host")).select(F.col("host").alias("of"), "n_host")
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where((F.col("n_texts") > max_docs) | (F.col("n_texts") > max_share * F.col("n_host")))
    return flat, above.select("host", "key", "n_texts")


def removals(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """``(host, text_key, removed_words, keys)`` of the texts that have lines above the limit."""
    flat, above = frequent_lines(docs, min_docs, max_share, max_docs)
    above = above.select(F.col("host").alias("of"), F.col("key").alias("bad"))
    met = flat.join(above, F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("bad")))
    return met.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"), F.collect_set("key").alias("keys"))


def line_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The base features of every row with removed_words and kept."""
    rows = base_features(docs.select("doc_id", "text", F.col("source").cast("string").alias("of_host")), ["doc_id", "of_host"])
    rows = rows.withColumn("of_text", _text_key(F.col("__text"))).drop("__text")
    gone = removals(docs, min_docs, max_share, max_docs).drop("keys")
    rows = rows.join(gone, F.col("of_host").eqNullSafe(F.col("host")) & (F.col("of_text") == F.col("text_key")), "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((left < min_left * F.col("n_words")) | (left < MIN_WORDS))
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False)))
    return rows.drop("of_host", "of_text", "host", "text_key")


def clean_rows(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of docs that line_rules keeps, their lines above the limit removed and n_chars, if there, made to match."""
    marked = docs.select(in_one_column(docs), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("of_host"), _text_key(F.col("text").cast("string")).alias("of_text"))
    gone = cut_lineage(removals(docs, min_docs, max_share, max_docs))
    if gone.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0] <= BROADCAST_REMOVALS:
        gone = F.broadcast(gone)
    rows = marked.join(gone, F.col("of_host").eqNullSafe(F.col("host")) & (F.col("of_text") == F.col("text_key")), "left")
    kept_lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("keys"), _line_key(_normal(x))))
    rows = rows.withColumn("clean", F.when(F.col("keys").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    judged = base_features(rows, ["row", "removed_words", "clean"])
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((left < min_left * F.col("n_words")) | (left < MIN_WORDS))
    judged = judged.where(~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False)))
    columns = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return judged.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
