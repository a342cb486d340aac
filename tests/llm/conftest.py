import random

import pytest

DOCS = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id long, size string, _text int"


@pytest.fixture(scope="session")
def given(spark):
    """The 200 documents of the smallest table, as (id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeats."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    lines = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(30))
    return [
        (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, " \t\n "), (5, "alpha  beta\tgamma delta epsilon"),
        (6, long), (7, long + " end"), (8, lines), (9, lines.replace("w1 ", "w2 ", 1)), (10, "É caf́e ßtraße  x\x00y"),
        (11, "one"), (12, "one"), (13, "ab" * 300), (14, "ab" * 260 + "tail"), (15, lines + "\n" + lines),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as documents whose other columns have clashing names and nulls."""
    return spark.createDataFrame([(i, t, None, None if i % 3 else f"s{i % 2}", None, "kept?", -i, "size", 0)
                                  for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, odd_rows):
    """Rows that repeat in whole, in id only, and with null ids."""
    rows = [*odd_rows[:6], odd_rows[0], (1, "another text under one id, long enough to count"), (None, "no id at all here, sorry"),
            (None, "no id at all here, sorry"), (None, None), odd_rows[7], odd_rows[7], odd_rows[8]]
    return spark.createDataFrame([(i, t, "en", None, 1, None, 0, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
