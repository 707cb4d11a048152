"""Awkward tables that every operator of the package has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for columns of their own
    T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("label", T.StringType()),
])


def prose(n: int, seed: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(min(n, words)))


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    """Nulls, empty and blank texts, a very long one, ties, copies and non-ASCII texts."""
    long = prose(20_000, 1, 20_000)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one"), (5, "Ünïcode ß 漢字 emoji 😀 text\nwith lines\r\nand more"), (6, long), (7, long),
        (8, prose(200, 2)), (9, prose(200, 2)), (10, prose(200, 2).upper()), (11, "a b c"), (12, prose(120, 3) + "\n" + prose(80, 4), None),
        (13, prose(80, 4) + "\n" + prose(120, 5), "t"), (14, "<|endoftext|> </s> [INST]" + prose(90, 6), "t"), (-5, prose(60, 7), "u"),
    ]
