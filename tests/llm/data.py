"""Small corpora for the corpus operators' tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for columns of their own.
CLASHING = ["score", "predicted", "kept", "keep_id", "n", "id", "len", "sha", "rest", "size", "taken", "target", "source_size", "component_id", "fp", "rule", "sequence_id", "offset", "spans", "found", "late", "y", "g"]

WORDS = "stone river light house green winter market paper silver garden window bridge summer letter mountain table music field harbour candle".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "er", "ly", "ing")) for _ in range(n))


def corpus(n: int = 60, seed: int = 1, words: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(5, words)), "en", f"s{i % 5}", 0) for i in range(n)]


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, ties, and a very long text."""
    rng = random.Random(9)
    long = prose(rng, 60_000)
    return [
        (None, "lone text without an id", None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "b", 3), (4, "one two  three", "en", None, 4),
        (5, "one two three", "en", "b", 5), (5, "one two three", "en", "b", 5), (6, "One TWO three", "en", "b", 5), (7, long, "en", "a", len(long)), (8, long + " end", "en", "c", None),
        (9, "é ü ß İstanbul ΣΑΣ 漢字 🙂 ﬁ", "de", "c", 9), (10, "x" * 5000, "en", "c", 5000), (None, None, None, None, None), (11, "a b", "en", "", 1),
    ]


def frame(spark, rows, clashing: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
