"""Small tables with everything that a table should not have."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("row", "n", "h", "w", "at", "key", "doc", "th", "pos", "start", "rep", "own", "token", "label", "said", "bucket", "size", "shard", "prior", "digest", "vec", "a", "b")


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    long = words(random.Random(1), 6000)
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", None, 10),
        (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", None, 10),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, "a", None),
        (5, " \t\n \n", "xx", "b", 3),
        (6, long, "de", "b", len(long)),
        (7, long, "de", "a", len(long)),
        (8, "ÄÖÜ ñandú 漢字 \U0001f600 café", "es", "c", 5),
        (9, "one", "fr", "c", 1),
        (9, "two words", "fr", "c", 1),
        (10, "x\n" * 50, "fr", "c", 100),
        (None, None, None, None, None),
    ]


def frame(spark, rows, schema=DOCS, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}) if clash else df


def odd(spark):
    return frame(spark, odd_rows())


def empty(spark):
    return frame(spark, [])
