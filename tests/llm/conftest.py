import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé1") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, long), (6, long), (7, long + " x"), (None, "a b c d"), (None, None), (8, "a b c d"), (9, "A B\nc  d")]
    rows += [(10, "x" * 200_000), (11, "a1" * 50_000 + "@" + "b." * 50_000), (12, "tie tie tie tie\n" * 40), (13, "tie tie tie tie\n" * 40), (14, "\U0001f600 é\x1c a\x0b b")]
    wide = [(i, t, "en", "src1", len(t or ""), 0, "t", 1, "key", "fp") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n int, t string, p int, key string, fp string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
