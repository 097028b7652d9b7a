import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators might use themselves.
CLASHES = ["size", "key", "fp", "spans", "block", "batch", "score", "rank", "copies", "target", "next", "found_email", "component_id", "source_", "mix_id", "row_at", "toxic_score", "body"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows():
    base = prose(120, 1)
    rows = [(i, prose(60 + i, i + 10), "en", f"s{i % 4}", 0) for i in range(1, 25)]
    rows += [
        (100, None, "en", "s0", None),
        (101, "", "de", "s1", 0),
        (102, " \n\t ", None, None, 3),
        (None, prose(40, 3), "fr", None, 1),
        (None, None, None, None, None),
        (103, base, "en", "s0", 1),
        (104, base, "xx", "s2", 1),  # an exact copy
        (105, base + " end", "en", "s2", 1),  # a near copy
        (106, prose(50, 4), "en", "s3", 1),
        (106, prose(50, 4), "en", "s3", 1),  # a repeated row
        (106, prose(30, 5), "en", "s3", 1),  # its id with another text
        (107, prose(30_000, 6) + " mail me at jo.doe@mail.example.com", "en", "s3", 1),
        (108, "ünï çødé 𝒳 " * 30, "fr", "s1", 1),
        (109, "1" * 50_000, "en", "s1", 1),
        (110, "word " * 400, "en", "s1", 1),
        (-5, "below zero", "en", "s1", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, copies and repeats, and columns with taken names."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def rows():
    return odd_rows()
