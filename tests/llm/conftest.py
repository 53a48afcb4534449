import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, shard int, part int, score double"


def words(rnd, n):
    return " ".join("".join(rnd.choice(("th", "er", "on", "an", "re", "ou", "é")) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def row(i, text):
    return (i, text, "en", None, len(text or ""), "h", "k", 1, 2, 0.5)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, white space, copies, repeated rows, a long text, lines of all kinds; columns whose names clash with inner ones."""
    rnd = random.Random(11)
    long = words(rnd, 20_000)
    shared = "This Line Is Shared By Many"
    texts = [
        None, "", " ", "\n", "\t \x0b", "a", "a b", "The  cat\tsat", "The cat sat", "the cat sat", long, long, long + " x",
        f"{shared}\nown line number one\n{shared}", f"  {shared.lower()}\r\nshort\nshort", "short\nown line number two", "É" * 12 + "\nx", "É" * 12, "ABC DEF GHI JKL MNO PQR",
        "line one is here\n\nline one is here", " \x00odd\u2028sign\u0085 ", "日本語のテキスト 12345 " * 3, "x" * 5000,
    ]
    texts += [words(rnd, rnd.randint(1, 80)) for _ in range(25)]
    base = words(rnd, 300).split(" ")
    for k in range(6):
        near = list(base)
        near[50 + k] = "changed"
        texts.append(" ".join(near))
    rows = [row(2 * i + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[11], row(None, "a text without an id"), row(None, None), row(1000, texts[13])]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
