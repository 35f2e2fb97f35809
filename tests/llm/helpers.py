"""Small document tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or return.
CLASHING = ["_x", "_doc", "_stats", "_kept", "_id", "_size", "_place", "_fp", "fp", "last", "score", "size", "label", "kept", "piece", "rule", "fence_upper", "_source", "_copy", "sequence_id", "vft"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)) + "."


def odd_rows(seed=3, n=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(rng.randint(1, 12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]), 1) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n\r\x0b\x0c ", "en", "a", 7), (n + 3, "x", "de", "b", 1), (None, "a null id", "en", "a", 9), (None, None, None, "b", None)]
    rows += [(n + 4, "ÄÖ é ñ\x1c\x85\xa0 中文 🎉 <|endoftext|>  two  spaces\n\n\n three", "fr", "c", 5), (n + 5, " ".join(["longword"] * 30_000), "en", "c", 1), (n + 6, "same line\n" * 60, "en", "c", 1)]
    rows += [rows[0], rows[0], (n + 7, rows[1][1], "en", "b", 1)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


def content(df):
    """Rows as sorted texts: for comparisons as multisets."""
    return sorted(map(str, df.collect()))
