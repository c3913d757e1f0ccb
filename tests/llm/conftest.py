import random

import pytest

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["the", "of", "stone", "river", "lamp", "green", "seven", "cloud", "north", "paper", "wind", "tale", "iron", "glass"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = "\n".join(prose(50, k) for k in range(1200))
    rows = [(1, prose(60, 1), "en", "a", 10), (2, None, "en", "a", None), (3, "", None, "a", 0), (4, " \t\n \x0b", "fr", None, 4),
            (5, long, "en", "b", 1), (6, prose(60, 1), None, None, 10), (7, "short", "fr", "a", 5), (8, prose(30, 4) + "\nßé 中文 😀 İ", "fr", "b", 3),
            (None, prose(25, 9), "fr", "a", 1), (9, "12 34 !! ??", "en", "b", 2)]
    return rows + [rows[0], rows[2]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns of names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["n_words", "n_hit", "score", "lang_pred", "kept", "sequence_id", "offset", "words", "runs", "uid", "shard", "node", "bands", "label",
             "own", "lines", "n_lines", "key", "lettered", "mixture", "n_tokens", "toxic_margin", "hit_words", "contaminated", "hashed"]
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
