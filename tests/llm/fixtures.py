"""Documents with nulls, empty and very long texts, ties, repeats and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["k", "h", "b", "g", "pos", "len", "gram", "line", "host", "fp", "root", "score", "x", "count", "held", "__x", "position", "shard", "__d", "__k", "__n", "__c", "__s", "__l", "row", "salt"]


def messy_rows(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(70)
    rows = [
        (1, None, "en", "s1", None),
        (2, "", "en", "s1", 0),
        (3, " \t\n\r\x0b\x0c ", None, "s1", 6),
        (4, "one", "en", None, 3),
        (5, "Two words", "en", "s2", 9),
        (6, text(30_000), "de", "s1", None),
        (7, shared, "en", "s1", None),
        (8, shared, "en", "s1", None),
        (9, shared + " tail", "en", "s2", None),
        (10, "\n".join(["Same  Line here"] * 40), "en", "s1", None),
        (11, "A b  c d \U0001f600 naïve ÀÉ", "fr", "s2", None),
        (None, "no id here at all", None, None, None),
        (12, "a b a b a b a b c", "en", "s1", None),
        (12, "a b a b a b a b c", "en", "s1", None),
        (12, "another text of the same id", "en", "s1", None),
        (13, "<|endoftext|> <| x", "en", "s1", None),
        (14, "#*$%&|<> 1 2,3", "en", "s1", None),
    ]
    rows += [(100 + i, text(r.randint(1, 200)) + ("\nCommon footer line" if i % 2 else ""), r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", "s3"]), None) for i in range(60)]
    return rows


def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
