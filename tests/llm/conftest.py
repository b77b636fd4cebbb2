import random

import pytest

SCHEMA = "doc_id long, text string, lang string, _text string, _k0 string, score string, base int, spans int, id long, rep long, n_tokens long"


def row(i, t):
    return (i, t, None, "x", "y", "z", 1, 2, 3, 4, 5)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long and unusual texts, repeated rows and ties."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "日本", "42", "x,y", "<|endoftext|>", "don't", "😀"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    same = "the quick brown fox jumps over the lazy dog again and again until the end of the day"
    texts = [None, "", " ", "\n\t ", "one", "two words", same, same, same + " or so", long, "a" * 50_000, "\x00\x1c\x85 ", "é" * 300, "password = \"hunter2hunter2\""]
    return [(i, t) for i, t in enumerate(texts)] + [(6, same), (None, same), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame([row(*x) for x in odd_texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
