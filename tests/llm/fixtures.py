"""Small documents with every awkward case: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; an input may have them too.
CLASHES = ("score", "fp", "size", "label", "words", "n_words", "kept", "component_id", "root", "host", "key", "target", "bucket", "piece", "ids", "row", "lang_pred", "node", "vector", "turns", "id", "dropped_id", "__words", "__id", "__row", "__k", "__h")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ta", "ro", "ne", "sha", "mi", "ul", "gon", "per")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    shared = "\n".join("Every page of this host repeats line %d of its menu" % (k % 3) for k in range(3))
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(3, 30)).capitalize() + "." for _ in range(rng.randint(1, 8)))
        if i % 2 == 0:
            text = shared + "\n" + text
        rows.append((i, text, rng.choice(("en", "de", None)), rng.choice(("a", "b", "b", "é", "", None)), len(text)))
    rows += [
        (n, None, "en", "a", None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t\x0b\x0c\r ", "en", "a", 7), (n + 3, "Word", None, None, 4), (n + 4, "two words", "en", "b", 9),
        (n + 5, "A b C d e f G h " * 9, "en", "b", 0), (n + 6, "a B c D e f g H " * 9, "en", "b", 0), (n + 7, sentence(rng, 9000), "en", "b", 0),
        (n + 8, "## $5 <b> | % & * ☃ 𝔘  non-break " * 8, "en", "b", 0), (n + 9, "same\nsame\n\nsame \n" * 12, "en", None, 0),
        (None, "a document without an id", "en", "b", 0), (None, None, None, None, None), (3, "another text of a repeated id", "en", "a", 0),
    ]
    return rows + rows[:3] + rows[5:6] * 3


def frame(spark, rows, clashes: bool = True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in CLASHES if clashes else ():
        df = df.withColumn(c, F.lit("clash"))
    return df
