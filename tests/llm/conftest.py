import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, size string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows, copies, near copies, and clashing columns."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(150)
    near = base.split(" ")
    near[70] = "changed"
    texts = [None, "", "   \t\n ", "One", "Two words", base, base, " ".join(near), base.upper(), prose(20_000), "a" * 3000, prose(300) + " " + base, "é ß 日本 " * 40, ". , " * 300]
    texts += [prose(rng.randint(5, 200)) for _ in range(20)]
    texts += ["mail a.b@c.org and x@y.z@w.v +49 (30) 123-4567 10.0.0.300 192.168.0.1 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00", "under the Apache License, Version 2.0. MIT  license; CC-BY gnu GENERAL\npublic license"]
    rows = [(10 * i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[9], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
